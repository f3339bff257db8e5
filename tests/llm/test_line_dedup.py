import duckdb

from strandline.llm import line_dedup


def check(spark, rows, schema="doc_id long, text string, body string"):
    df = spark.createDataFrame(rows, schema)
    out = line_dedup.dedup_lines(df, report=True).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str)
    assert sorted(((r.doc_id, r.text, r.removed_chunks, r.removed_lines) for r in out), key=str) == want
    return out


def test_against_sql(spark):
    shared = "\n".join(f"line {k} of a shared passage" for k in range(30))
    rows = [(k, f"own {k}\n" * (k % 4) + shared + f"\nlast {k}", "x") for k in range(40)]
    rows += [(100, "a\nb", "x"), (101, "a\nb", "x"), (102, None, "x"), (103, "", "x"), (104, "\n\n\n\n", "x"), (105, "\n\n\n\n", "x"), (106, "y\n" * 5000, "x"), (107, "é\nü", "x"), (108, "é\nü", "x")]
    out = check(spark, rows)
    assert sum(r.removed_lines for r in out) > 30 * 20


def test_shifted_passage_is_found(spark):
    shared = "\n".join(f"line {k} of a shared passage" for k in range(60))
    out = check(spark, [(1, shared, None), (2, "new head\n" + shared, None), (3, "a\nb\nc\n" + shared + "\nz", None)])
    assert all(r.removed_lines > 40 for r in out if r.doc_id > 1)


def test_rows_alike_and_without_id(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (None, "c\nd")], "doc_id long, text string")
    out = line_dedup.dedup_lines(df).collect()
    assert sorted((r.doc_id is None, r.text) for r in out) == [(False, "a\nb"), (False, "a\nb"), (True, ""), (True, "c\nd")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_clashing_names(spark):
    names = ["_nos", "_gone", "_sha", "_id", "nos", "gone", "sha", "id", "row", "h", "body", "c", "n", "f", "i", "s", "a.b", "removed_lines"]
    rows = [(k, "a\nb", 3, *(f"{n}{k}" for n in names)) for k in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *names])
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(out.drop("text", "n_chars").collect()) == sorted(df.drop("text", "n_chars").collect())
    told = line_dedup.dedup_lines(df, report=True)
    assert sorted((r.doc_id, r.text, r.n_chars, r.removed_lines, r["a.b"]) for r in told.collect()) == [(0, "a\nb", 3, 0, "a.b0"), (1, "", 0, 2, "a.b1"), (2, "", 0, 2, "a.b2")]
