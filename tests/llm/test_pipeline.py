"""The stages' contract on small and on odd tables, and the guard of the entry file."""

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    n, sizes = docs.count(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] == n and sizes[2] <= n and sizes[3] == sizes[2]


def test_odd_tables(spark, tmp_path):
    """Nulls, empty, wordless, repeated and very long texts, columns with the operators' own names: what each stage makes of them."""
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(60_000))
    line = "some words of text to keep here"
    odd = [(1, None, "en"), (2, "", None), (None, line, "en"), (3, "12 !!", "en"), (3, "12 !!", "en"), (4, long, "en"), (5, long, "en"), (6, line, "en"), (6, line, "en"), (7, f"{line}\n13 !!", None)]
    extra = "row_key string, `_key` int, chunk int, CUT int, id long"
    want = {
        "language": [(None, line), (4, long), (5, long), (6, line), (6, line), (7, f"{line}\n13 !!")],
        "line_dedup": [(None, line), (4, long), (5, ""), (6, ""), (6, ""), (7, "13 !!")],
        "near_dedup": [(None, line), (4, long), (5, ""), (7, "13 !!")],
        "substring_dedup": [(None, line), (4, long), (5, ""), (7, "13 !!")],
    }
    for k, rows in enumerate(([], odd)):
        docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "x", 1, 2, 3, 9) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name in want:
                got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()), key=str)
                assert docs.columns == names and got == sorted(((-1 if i is None else i, t) for i, t in (want[name] if rows else [])), key=str), name
                assert all((r["row_key"], r["_key"], r["chunk"], r["CUT"], r["id"], r["n_chars"]) == ("x", 1, 2, 3, 9, len(r["text"])) for r in docs.collect())
        assert {r["doc_id"] for r in docs.collect()} == ({None, 4, 7} if rows else set())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_short_lines_with_edits_go_in_the_stage(spark):
    """Lines of one and two words with an edit are cut by the pipeline's own stage, with n_chars of what is left."""
    rows = [(1, "Impressum\nread more\nonly here"), (2, "Impresum\nsomething else altogether\nread mare")]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("something else altogether", 25)}
