from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import langid, quality_rules
from tallyline.llm.shared import ship
from tests.llm import brute


def plain_clean(text):
    """The rules line after line; None if the document goes."""
    n, chars, _, _, _, failed = brute.rules_base(text)
    kept, seen, left = [], set(), 0
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        size = sum(map(len, words))
        if not words:
            kept.append(line)
            continue
        symbols = len(re.findall(r"[#*$%&|<>]", line))
        fails = (
            (line in seen and len(words) >= 3) or (len(words) < 5 and not re.search(r"[.!?…:;。！？][\"'”’»)\]*]*$", words[-1])) or (len(words) >= 3 and line.isupper())
            or 5 * sum(w in "|»›>•·" for w in words) >= len(words) or 10 * symbols > size
            or (len(words) <= 40 and any(p in line.lower() for p in quality_rules.BOILERPLATE))
        )
        seen.add(line)
        if not fails:
            kept.append(line)
            left += size
    return None if failed or 2 * left < chars else "\n".join(kept)


def test_cleaned_texts_equal_the_plain_loop(spark, sf):
    ship(spark)
    rng = random.Random(8)
    lines = ["Home | About | Contact", "A sentence of some words that ends well.", "stub", "ALL UPPER CASE HERE", "", "  ", "Terms of use apply to this page.", "# $ % & x", "Another good line, with an end!"]
    docs = ["\n".join(rng.choice(lines) + rng.choice(["", f" {rng.randint(0, 99)}."]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "word " * 30]
    rows = [(i, t, "x") for i, t in enumerate(docs)]
    rows += [(1000 + r["doc_id"], r["text"], "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cleaned string")
    made = quality_rules.clean(frame)
    assert made.columns == frame.columns
    want = {i: plain_clean(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {i: t for i, t in want.items() if t is not None}
    stage = corpus_pipeline.clean(spark, frame.drop("cleaned").withColumn("n_chars", F.lit(-1).cast("long")), sf)
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == want[r["doc_id"]] for r in stage.collect())


def test_number_signs_are_no_letters(spark):
    frame = spark.createDataFrame([(i, f"plain words of a language {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(frame)
    asked = spark.createDataFrame([(1, "½ ² ①"), (2, "12 _ -"), (3, "½ words"), (4, None), (5, ""), (6, "日")], "doc_id long, text string")
    made, names = langid.identify(asked, model)
    got = {r["doc_id"]: r[names["lang_pred"]] for r in made.collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "und", 5: "und", 6: "en"}
