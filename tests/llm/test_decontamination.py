import re

from slotwise.llm import decontamination as D

ITEM = " ".join(f"q{i}" for i in range(16))


def brute(text, items):
    words = D.WORDS.findall((text or "").translate(D.FOLD))
    hit, found = set(), set()
    for item_id, item in items:
        for window in D.item_windows(item):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add("null" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found)


def test_matches_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = docs.where("n_chars < 6000")
    rows = D.matches(some.select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")).withColumn("n_hit", D.n_hit("hits"))
    for r in rows.collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, items)


def test_windows_overlap_short_items_and_ties(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short item"), (3, None), (4, "..."), (None, "Null id!")], "item_id long, text string")
    texts = [ITEM + " " + ITEM, "x " + ITEM.upper() + " y", " ".join(ITEM.split()[:12]), "a Short, ITEM b", "null id", None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    for r in D.matches(docs, items).withColumn("n_hit", D.n_hit("hits")).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, pairs), r


def test_a_large_benchmark_is_scanned_in_shards_with_the_same_result(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = D.report(docs, bench).orderBy("doc_id").collect()
    assert D.report(docs, bench, shard_bytes=4000).orderBy("doc_id").collect() == whole
    assert any(r.contaminated for r in whole) and not all(r.contaminated for r in whole)


def test_offsets_map_to_the_original_text():
    text = "Intro: " + ITEM.upper().replace(" ", " -- ") + " end"
    [(a, b)] = D.hit_text(text, [("1", ITEM)])
    assert text[a:b].startswith("Q0") and text[a:b].endswith("Q15") and len(re.findall("Q", text[a:b])) == 16


def test_awkward_rows(awkward, no_docs, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    kept = D.clean(awkward, bench)
    assert kept.columns == awkward.columns
    assert kept.count() == awkward.where("text is null or lower(text) not like '%quick brown%'").count()
    assert D.report(awkward, bench.where("false")).where("contaminated or n_items > 0").count() == 0
    assert D.report(no_docs, bench).count() == 0 and D.clean(no_docs, bench).count() == 0
