"""Secret scans (built-in functions only).

Three patterns find well-known forms. Beside them, candidate strings are read
by a sliding window: the window keeps a count per symbol of a character class,
one symbol enters and one leaves at each step, and the sum of ``n log2 n`` is
updated from those two counts alone. Windows of high Shannon entropy that mix
the groups of their class become spans, unless the patterns' spans already
cover them or the allow-list knows the string. A word of the allow-list speaks
for the piece between separators that holds it: a candidate with another piece
as long as a window is read all the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, table, without

WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEY = f"({'|'.join(_either_case(w) for w in WORDS)})"
ASSIGN = KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # of maximal runs those of 18 and more
HEX = "[0-9a-f]{16,}"
SYMBOLS = "[A-Za-z0-9+/_=-]"
LETTERS = SYMBOLS.replace("0-9", "")
#: Maximal runs of at least 20 symbols with a digit.
CANDIDATE = f"(?<!{SYMBOLS})(?={LETTERS}*[0-9]){SYMBOLS}{{20,}}"
ALLOW = "example|sample|placeholder|changeme|dummy|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
WINDOW = 20
SEPARATORS = "[_=/+-]"
#: kind: symbols, whether case counts, groups (first and last symbol, from 1) that a window must mix, least entropy in bits
CLASSES = {
    "entropy_hex": ("0123456789abcdef", False, ((1, 10), (11, 16)), 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", True, ((1, 26), (27, 52), (53, 62)), 3.8),
}
KINDS = ("assign", "access", "hex", *CLASSES)
SPAN = "struct<start:int,no:int,end:int,kind:string,found:string>"


def _matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters, from the pieces between matches."""
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else -1).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), x["whole"].alias("found")
        )
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(F.length(x["part"]) >= least, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"),
        )

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _window_spans(kind: str) -> str:
    """SQL over a candidate ``c``: spans of high entropy, as an array of structs."""
    symbols, cased, groups, least = CLASSES[kind]
    size, w = len(symbols), WINDOW
    logs = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(w + 1)) + ")"
    char = "ch" if cased else "lower(ch)"
    codes = f"transform(filter(split(c.found, ''), ch -> ch != ''), ch -> instr('{symbols}', {char}))"
    steps = f"zip_with({codes}, concat(array_repeat(-1, {w}), {codes}), (i, o) -> named_struct('i', i, 'o', o))"
    n_out = "element_at(a.n, x.o)"
    n_in = "(element_at(a.n, x.i) - if(x.i = x.o, 1, 0) + 1)"
    total = (
        f"(a.s + if(x.o > 0, element_at({logs}, {n_out}) - element_at({logs}, {n_out} + 1), 0D)"
        f" + if(x.i > 0, element_at({logs}, {n_in} + 1) - element_at({logs}, {n_in}), 0D))"
    )
    bad = "(a.bad + if(x.i = 0, 1, 0) - if(x.o = 0, 1, 0))"
    mixed = [f"(a.g{k} + if(x.i BETWEEN {lo} AND {hi}, 1, 0) - if(x.o BETWEEN {lo} AND {hi}, 1, 0))" for k, (lo, hi) in enumerate(groups)]
    good = f"(a.at >= {w - 1} AND {bad} = 0 AND {' AND '.join(f'{m} > 0' for m in mixed)} AND {math.log2(w)!r}D - {total} / {w} >= {least - 1e-9!r}D)"
    span = f"named_struct('start', c.start + a.from, 'no', {KINDS.index(kind)}, 'end', c.start + a.to, 'kind', '{kind}', 'found', '')"
    joins = f"(a.from >= 0 AND a.at + 1 - {w} <= a.to)"
    merge = f"""(a, x) -> if(x.i IS NULL, a, named_struct(
        'at', a.at + 1,
        'n', transform(a.n, (v, k) -> v + if(k + 1 = x.i, 1, 0) - if(k + 1 = x.o, 1, 0)),
        's', {total}, 'bad', {bad}, {', '.join(f"'g{k}', {m}" for k, m in enumerate(mixed))},
        'from', if({good} AND NOT {joins}, a.at + 1 - {w}, a.from),
        'to', if({good}, a.at + 1, a.to),
        'out', if({good} AND NOT {joins} AND a.from >= 0, array_append(a.out, {span}), a.out)))"""
    zero = f"named_struct('at', 0, 'n', array_repeat(0, {size}), 's', 0D, 'bad', 0, {', '.join(f"'g{k}', 0" for k in range(len(groups)))}, 'from', -1, 'to', -1, 'out', CAST(array() AS array<{SPAN}>))"
    return f"aggregate({steps}, {zero}, {merge}, a -> if(a.from >= 0, array_append(a.out, {span}), a.out))"


@apart("text")
def find_secrets(docs: DataFrame, allow: str = ALLOW) -> DataFrame:
    """``docs`` with ``spans``: array of (start, no, end, kind, found) by start, then kind.

    Offsets count code points, ends are exclusive, and an assignment's span is
    its whole match. Defined results: a null or empty text has no spans;
    repeated rows are scanned each on their own; an empty table gives an empty
    table; an input column named ``spans`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        _matches(text, ASSIGN, "assign", group=2, least=12), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")
    )
    kept = without(docs, "spans", "_base", "_cands")
    found = kept.withColumns({"_base": F.array_sort(base), "_cands": _matches(text, CANDIDATE, "candidate")})
    foreign = lambda c: F.exists(F.split(c, SEPARATORS), lambda p: (F.length(p) >= WINDOW) & ~F.lower(p).rlike(allow))
    cands = F.filter("_cands", lambda c: ~F.lower(c["found"]).rlike(allow) | foreign(c["found"]))
    classes = ", ".join(_window_spans(k) for k in CLASSES)
    windows = F.expr(f"flatten(transform(_cands, c -> concat({classes})))")
    # How far the patterns' spans, by start, cover a span from its start on without a gap.
    covered = lambda x: F.aggregate("_base", x["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    added = F.filter(windows, lambda x: covered(x) < x["end"])
    return (
        found.withColumn("_cands", cands)
        .withColumn("spans", F.when(F.size("_cands") > 0, F.array_sort(F.concat("_base", added))).otherwise(F.col("_base")))
        .drop("_base", "_cands")
    )


@apart("text", "spans")
def redact(found: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``text`` with each group of overlapping spans replaced by ``mark``; rows without spans stay as they are."""

    def step(a, x):
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] >= a["at"]) | (a["out"] == ""),
                F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit(mark)),
            )
            .otherwise(a["out"])
            .alias("out"),
        )

    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda no: F.size(F.filter("spans", lambda x: x["no"] == no)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda x: x["no"] < 3)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def _sql_matches(no: int, kind: str, pattern: str, test: str) -> str:
    return f"""SELECT id, {no} AS no, '{kind}' AS kind, start, start + length(m) AS stop, m FROM (
  SELECT id, m, g, CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT id, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k FROM (
    SELECT id, regexp_extract_all(text, $re${pattern}$re$, 0) AS ms, regexp_extract_all(text, $re${pattern}$re$, {2 if no == 0 else 0}) AS gs, regexp_split_to_array(text, $re${pattern}$re$) AS gaps FROM d))
  WINDOW w AS (PARTITION BY id ORDER BY k)) WHERE {test}"""


def _sql_windows(no: int, kind: str) -> str:
    symbols, cased, groups, least = CLASSES[kind]
    s = "m" if cased else "lower(m)"
    sub = f"substr({s}, st + 1, {WINDOW})"
    classes = [f"[{symbols[lo - 1]}-{symbols[hi - 1]}]" for lo, hi in groups]
    inside = "[A-Za-z0-9+/_=-]" if cased else "[0-9a-f]"
    return f"""SELECT id, {no} AS no, '{kind}' AS kind, min(st) AS start, max(st) + {WINDOW} AS stop, '' AS m FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY id, c0 ORDER BY st) AS island FROM (
   SELECT *, CASE WHEN st - lag(st) OVER (PARTITION BY id, c0 ORDER BY st) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM (
    SELECT id, start AS c0, start + st AS st FROM (SELECT *, {sub} AS win FROM (SELECT id, start, m, unnest(range(0, length(m) - {WINDOW - 1})) AS st FROM cand))
    WHERE regexp_full_match(win, '{inside}+') AND {' AND '.join(f"regexp_matches(win, '{c}')" for c in classes)}
      AND {math.log2(WINDOW)!r}::DOUBLE - list_sum([n * log2(n::DOUBLE) FOR n IN map_values(histogram_of(win))]) / {WINDOW} >= {least - 1e-9!r}::DOUBLE)))
  GROUP BY id, c0, island"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_sql_matches(0, "assign", ASSIGN, "length(g) >= 12")}
 UNION ALL {_sql_matches(1, "access", ACCESS, "true")}
 UNION ALL {_sql_matches(2, "hex", HEX, "true")}),
cand AS (SELECT id, start, m FROM ({_sql_matches(9, "candidate", SYMBOLS + "{20,}", f"regexp_matches(m, '[0-9]') AND (NOT regexp_matches(lower(m), '{ALLOW}') OR len([p FOR p IN regexp_split_to_array(m, '{SEPARATORS}') IF length(p) >= {WINDOW} AND NOT regexp_matches(lower(p), '{ALLOW}')]) > 0)")})),
added AS ({" UNION ALL ".join(_sql_windows(3 + k, c) for k, c in enumerate(CLASSES))}),
spans AS (SELECT id, no, kind, start, stop FROM base UNION ALL
 SELECT DISTINCT a.id, a.no, a.kind, a.start, a.stop FROM (SELECT *, unnest(range(start, stop)) AS p FROM added) a
 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = a.id AND b.start <= a.p AND a.p < b.stop)),
s AS (SELECT id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (WHERE no < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (id)
""".replace("map_values(histogram_of(win))", "[length(win) - length(replace(win, ch, '')) FOR ch IN list_distinct(string_split(win, ''))]")
