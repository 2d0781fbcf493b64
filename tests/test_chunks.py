"""Chunks against a plain loop, and their cost for a long text."""

import random
import re
import time

from pyspark.sql import functions as F

from braidwork.functions import text as X


def plain(text, size, least_cut, least):
    """As the SQL of chunk_texts: exactly ``size`` tokens from where the last chunk ended, also where a cut inside a token left as many."""
    found, at = [], 0
    while whole := re.compile(rf"(?:\s*+\S++){{{size}}}", re.A).match(text, at):
        whole = whole[0]
        last = max(whole.rfind(c) for c in ".?!\n") + 1
        found.append(whole[:last] if last > least_cut else whole)
        at += len(found[-1])
    found.append(text[at:])
    clean = [c.replace("\n", " ").strip(" \t\n\r\f\v") for c in found]
    return [c for c in clean if len(c) > least]


def chunked(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.chunks(F.col("t"), **how).alias("c")).collect()
    return [r.c for r in sorted(rows)]


def test_odd_texts(spark):
    rng = random.Random(5)
    pieces = ["a", "word", "é€", "e.g.x", "end.", "why?", "no!\n", ".", "...", "\n\n", "x" * 40, "x." * 30, " "]
    gaps = [" ", "  ", "\n", "\t", " \n "]
    texts = ["", " ", "\n", "one", " lead", "trail \n", "." * 500, "x" * 5000, "x. " * 5000, ("z" * 351 + ".") * 20 + " one" * 250, None]
    texts += ["".join(rng.choice(gaps) * rng.randint(0, 1) + rng.choice(pieces) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    for size, least_cut, least in ((200, 350, 5), (200, 10, 0), (7, 20, 0), (1, 0, 0), (3, 100, 5)):
        got = chunked(spark, texts, size=size, least_cut=least_cut, least=least)
        assert got == [None if t is None else plain(t, size, least_cut, least) for t in texts]


def test_cost_does_not_grow_with_the_tokens_of_a_chunk(spark):
    """1.5 MB; this failed where texts were joined and searched at every token."""
    text = "some words make a sentence of a text that is long. " * 30_000
    chunked(spark, ["warm up. " * 500])
    began = time.perf_counter()
    (got,) = chunked(spark, [text])
    assert time.perf_counter() - began < 10
    assert "".join(got).replace(" ", "") == text.replace(" ", "")
