"""The corpus pipeline, stage by stage against plain Python, on documents with known faults."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import common
from pagewright.llm.common import keep

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sentence(rng, n=80):
    return " ".join(f"w{rng.randrange(2000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, sentence(rng, 30)) for k in range(4)]
    docs, labels = [], []
    for i in range(400):
        text = sentence(rng)
        toxic = i % 8 == 0
        if toxic:
            text = text.replace(text.split()[5], "awful vile nasty")
        if i % 50 == 1:
            text = docs[-1][1].replace("w1", "w2", 1) if docs and docs[-1][0] % 8 else text
        if i % 50 == 3:
            text += "\n" + items[i % 4][1].upper()
        if i % 50 == 5:
            text += " token = abcdefgh12345"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs.append((None, sentence(rng), "en", None, 1))
    docs.append((900, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages(spark, corpus):
    folder, items = corpus
    before = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    (_, quality), (_, near), (_, clean), (_, secret), (_, pack) = corpus_pipeline.STAGES

    one = keep(quality(spark, before, folder), "t1")
    left = rows(one)
    assert one.columns == before.columns
    assert not any(i is not None and i < 900 and i % 8 == 0 for i in left)
    assert sum(i is not None and i % 8 != 0 for i in left) > 340 and None in left and 900 not in left

    two = keep(near(spark, one, folder), "t2")
    kept = rows(two)

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = {i: shingles(r["text"]) for i, r in left.items() if i is not None}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    gone = {j for _, j in linked}
    assert linked and set(kept) == (set(left) - gone)

    three = keep(clean(spark, two, folder), "t3")
    tests = [shingles(" ".join(WORD.findall(t.lower()))) for _, t in items]
    leaked = {i for i, r in kept.items() if i is not None and any(len(q & shingles(" ".join(WORD.findall(r["text"].lower())))) >= 0.8 * len(q) for q in tests)}
    assert leaked and set(rows(three)) == set(kept) - leaked

    four = keep(secret(spark, three, folder), "t4")
    masked = rows(four)
    for i, r in rows(three).items():
        hit = "token = " in r["text"]
        assert masked[i]["text"] == (r["text"].split("token = ")[0] + "[SECRET]" if hit else r["text"])
        assert masked[i]["n_chars"] == (len(masked[i]["text"]) if hit else r["n_chars"])
    assert any("[SECRET]" in r["text"] for r in masked.values())

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    expected = {}
    for i, r in masked.items():
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            expected[i, at] = (len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    five = pack(spark, four, folder).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in five} == expected

    assert corpus_pipeline.run(spark, folder).count() == len(five)


def test_rows_with_null_and_repeated_ids_are_decided_by_their_own_text(spark, corpus):
    folder, items = corpus
    rng = random.Random(10)
    a, b, c, d = (sentence(rng) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, a + " end"), (None, b), (None, b), (None, c), (None, c + " end"), (3, d), (3, items[0][1]), (None, items[1][1]), (4, ""), (4, ""), (5, None)]
    docs = keep(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "odd")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    near = texts(stages["near_duplicates"](spark, docs, folder))
    of_c = [t for t in near if t[0] is None and t[1].startswith(c)]
    assert len(of_c) == 1
    others = [(1, a), (1, b), (3, d), (3, items[0][1]), (None, items[1][1]), (4, ""), (4, ""), (5, None)]
    assert near == sorted([*others, *of_c], key=repr)
    clean = texts(stages["decontamination"](spark, docs, folder))
    assert clean == sorted([r for r in rows if r[1] not in (items[0][1], items[1][1])], key=repr)


def test_stages_keep_columns_of_any_name(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    names = ["_row", "own_blob", "found_spans", "_spans", "a.b", "keep", "fp", "component_id"]
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    docs = keep(docs, "named")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert all(r[n] == n for r in out.collect() for n in names)


def test_no_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns


def test_all_documents_rejected_leave_an_empty_corpus(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("text", F.lit(""))
    assert corpus_pipeline.STAGES[0][1](spark, docs, folder).count() in (0, docs.count())


def test_memory_that_the_driver_has_freed_goes_back_to_the_system(spark, monkeypatch):
    """Blocks outside the heap, freed below one that is still in use, as compiling many queries leaves them."""

    def resident():
        return int(re.search(r"Rss:\s+(\d+)", Path(f"/proc/{jvm.ProcessHandle.current().pid()}/smaps_rollup").read_text())[1]) / 1024

    jvm = spark._jvm.java.lang
    if not common.trim_driver(spark):
        pytest.skip("this JVM has no call for it")
    monkeypatch.setattr(common, "TRIM_SECONDS", 0)
    keep(spark.range(10), "warm")
    before = resident()
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(3000)]
    taken = resident() - before
    for d in held[:-1]:
        d.end()
    keep(spark.range(10), "after")
    given = resident() - before
    held[-1].end()
    assert taken > 150 and given < taken / 2, (before, taken, given)
