"""The stages in order, each on what the one before kept."""

import duckdb


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from loomspark.llm.pii import find

    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "mixing" or docs.columns == columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = {i for i, t in labels.items() if t}
    assert len(toxic & kept["toxicity"]) <= 0.4 * len(toxic)  # some fifty examples in four languages teach no more
    assert len({i for i, t in labels.items() if not t} - kept["toxicity"]) <= 0.01 * len(labels)
    after = spark.read.parquet(f"{tmp_path}/1")
    assert after.count() == after.select("text").distinct().count()
    con = duckdb.connect()
    assert con.sql(f"select count(*) from '{tmp_path}/2/*.parquet' d, '{sf}/benchmark.parquet' b where contains(d.text, b.text)").fetchall() == [(0,)]
    cleaned = find(spark.read.parquet(f"{tmp_path}/3"))
    assert cleaned.filter("size(email) > 0 or size(card) > 0 or size(phone) > 0 or size(ip) > 0").count() == 0
    assert kept["mixing"] == kept["pii"] == kept["decontaminate"]


def test_planted_cases_and_odd_rows(spark, tmp_path):
    """What each stage has to find, worked out by hand, among odd rows; then an empty table."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(words[(k * 37 + j * (k + 1)) % 400] for j in range(60))
    item = "the quick brown fox jumps over the lazy dog near the old river bank again"
    kim = "write to kim.field@example.org today"
    rows = [(i, text(i), "web") for i in range(20)]
    rows += [(20, text(3), "web"), (21, text(4).replace(text(4).split()[30], "changed"), "web"), (22, text(5), None)]
    rows += [(30, f"{text(30)} {item.upper()} {text(31)}", "books"), (31, f"{text(32)} {item.replace('old ', '')} {text(33)}", "books")]
    rows += [(40 + i, f"{text(40 + i)} {kim}", "books") for i in range(3)]
    rows += [(50 + i, f"{text(50 + i)} grubbler", "web") for i in range(12)]
    rows += [(70, None, "web"), (71, "", "web"), (1, text(1), "web"), (None, text(2), "web"), (None, text(80), "web"), (72, "z " * 30_000, None)]
    toxic = [(50 + i, 1) for i in range(12)] + [(i, 0) for i in range(20)] + [(None, 1), (40, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row_ string, h_ int, place_ double"
    spark.createDataFrame([(i, t, "xx", s, len(t or ""), "r", 7, 1.5) for i, t, s in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        assert name == "mixing" or docs.columns == names
    ids = {n: sorted((r.doc_id is None, r.doc_id or 0) for r in found) for n, found in seen.items()}
    every = sorted((i is None, i or 0) for i, _, _ in rows)
    held = [x for x in every if not 50 <= x[1] < 62]
    assert ids["toxicity"] == held
    single = sorted({x for x in held if x not in [(False, 20), (False, 21), (False, 22), (False, 71)] and not x[0]} | {(True, 0)})
    assert ids["near_dedup"] == single and sum(r.doc_id is None for r in seen["near_dedup"]) == 1
    assert next(r.text for r in seen["near_dedup"] if r.doc_id is None) == text(80)
    assert ids["decontaminate"] == [x for x in single if x not in [(False, 30), (False, 31)]] == ids["pii"] == ids["mixing"]
    cleaned = {r.doc_id: r for r in seen["pii"]}
    assert all("[EMAIL]" in cleaned[40 + i].text and "kim.field" not in cleaned[40 + i].text for i in range(3))
    assert all(cleaned[i].text == text(i) and cleaned[i].row_ == "r" and cleaned[i].h_ == 7 for i in range(20)) and cleaned[70].text is None
    assert all(r.n_chars == len(r.text or "") for r in seen["pii"])
    assert all(r.taken <= 3 * r.size for r in seen["mixing"])
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
