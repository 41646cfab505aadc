import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))

from helpers import docs, odd_rows

from adlens.llm import linededup as L


def plain(rows, ratio, least):
    pages, seen = Counter(s for *_, s in rows), Counter()
    for _, t, s in rows:
        for line in set((t or "").split("\n")):
            if t is not None and line.strip():
                seen[s, line] += 1
    common = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (s, x) not in common]
        out.append((i, None if t is None else "\n".join(kept), s, len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def test_lines_of_a_site(spark):
    rows = [(i, f"header\nown {i}\n\nfooter {i % 2}\nown {i}", "a") for i in range(20)]
    rows += [(100 + i, f"header\nown {i}\n  \nfooter", "b" if i else None) for i in range(6)]
    rows += [(200 + i, f"line {i}\nheader", "c") for i in range(3)]  # too few pages
    rows += [(300, None, "a"), (301, "", "a"), (302, "header", "a"), (302, "header", "a"), (None, "header\nx", "a")]
    df = docs(spark, rows, lines=1, page="p", site=2, line=3, n_lines="clash", n_dropped="clash")
    out = L.drop_lines(df.repartition(4), ratio=0.4, min_pages=5, report=True)
    got = sorted(str((r["doc_id"], r["text"], r["source"], r["n_lines"], r["n_dropped"])) for r in out.collect())
    assert got == plain(rows, 0.4, 5)
    assert "n_lines" in out.columns and "lines" in out.columns
    assert L.drop_lines(df).columns == df.columns
    assert L.drop_lines(df.limit(0), report=True).collect() == []


def test_odd_rows(spark):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "src0") for r in odd_rows()]
    got = L.drop_lines(docs(spark, rows), ratio=0.2, min_pages=2, report=True).collect()
    assert sorted(str((r["doc_id"], r["text"], r["source"], r["n_lines"], r["n_dropped"])) for r in got) == plain(rows, 0.2, 2)


def test_no_python_in_the_plan(spark):
    df = L.drop_lines(docs(spark, odd_rows()), report=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))


PASSAGE = " ".join(f"passage{i}" for i in range(60))


def test_ratio_by_length(spark):
    # a site of 400 pages: nothing below reaches 8 % (33 pages)
    rows = [[i, f"own{i} a\nown{i} b c d e f g h i j k l m\nown{i} z", "a"] for i in range(400)]
    plant = {"and so on": range(0, 20), "seven words that no chance brings together": range(30, 36),
             PASSAGE: range(40, 45), "four pages have all these seven words": range(50, 54),
             "six words on few pages only": range(60, 66)}
    for line, pages in plant.items():
        for i in pages:
            rows[i][1] += "\n" + line
    for i in range(40, 45):  # more of its own than of the passage
        rows[i][1] += "\n" + " ".join(f"mine{i}word{k}" for k in range(90))
    copies = [f"copy of a longer text with many words {k} a b c" for k in range(12)]
    rows += [[500 + i, "\n".join([*copies, f"edited {i}"]), "a"] for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in L.drop_lines(docs(spark, rows), by_length=True).collect()}
    left = {line: sum(line in t.split("\n") for t in got.values()) for line in plant}
    assert left == dict(zip(plant, (20, 0, 0, 4, 6)))
    # near copies keep their content, all else is as it was
    assert all(got[i] == t for i, t, _ in rows if i >= 500)
    gone = {"seven words that no chance brings together", PASSAGE}
    assert all(got[i] == "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _ in rows)
    plain_kept = {r["doc_id"]: r["text"] for r in L.drop_lines(docs(spark, rows)).collect()}
    assert plain_kept == {i: t for i, t, _ in rows}


def test_pipeline_goes_by_length(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    import corpus_pipeline as C
    rows = [(i, f"own{i} text" + ("\nseven words that no chance brings together" if i < 6 else ""), "a")
            for i in range(400)]
    rows = [(i, t + "\n" + " ".join(f"w{i}x{k}" for k in range(20)), s) for i, t, s in rows]
    got = C.cut_lines(spark, docs(spark, rows), "").collect()
    assert not any("no chance" in r["text"] for r in got) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_copies_are_one_page(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    import corpus_pipeline as C
    copy = "\n".join(f"line {k} of a text that was copied" for k in range(8))
    rows = [(i, f"header\nown {i} and more words", "a") for i in range(40)]
    rows += [(100 + i, copy, "a") for i in range(20)]  # a third of the site
    rows += [(200 + i, "all pages\nof the site", "b") for i in range(6)] + [(300 + i, None, "c") for i in range(6)]
    want = {i: None if t is None else t.removeprefix("header\n") for i, t, _ in rows}
    cut = C.cut_lines(spark, docs(spark, rows).repartition(5), "").cache()
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    firsts = {r["doc_id"]: r["text"] for r in C.keep_firsts(spark, cut, "").where("text is not null").collect()}
    assert firsts[100] == copy and firsts[200] == rows[60][1] and not {*range(101, 120), *range(201, 206)} & set(firsts)


def query(spark, rows, folder):
    """The registered query over rows written as a table."""
    from adlens.llm.queries import QUERIES
    docs(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return QUERIES["op10_line_dedup"](spark, folder)


def test_query_loses_no_copied_text(spark, tmp_path):
    """A group of copies that is a third of its site keeps its text; the boilerplate of all its pages goes."""
    copy = "\n".join(f"line {k} of a text that was copied" for k in range(8))
    rows = [(i, f"header\nown {i} and more words", "a") for i in range(40)] + [(100 + i, "header\n" + copy, "a") for i in range(20)]
    rows += [(200 + i, "six copies\nand nothing else", "b") for i in range(6)] + [(300, None, "a"), (301, "", None)]
    out = query(spark, rows, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {i: t and t.removeprefix("header\n") for i, t, _ in rows}


def test_query_and_its_sql_on_planted_lines(spark, tmp_path):
    import duckdb
    rows = [[i, f"own{i} a\nown{i} b c d e f g h i j k l m\nown{i} z", "a"] for i in range(400)]
    for line, pages in {"and so on": range(40), "seven words that no chance brings together": range(30, 36), PASSAGE: range(40, 45),
                        "four pages have all these seven words": range(50, 54), "top": range(100, 300)}.items():
        for i in pages:
            rows[i][1] += "\n" + line
    rows += [[500 + i, "\n".join(["top", PASSAGE, f"edited {i}"]), "a"] for i in range(8)] + [[600, None, "a"], [601, " \n\n", None]]
    out = query(spark, rows, str(tmp_path))
    got = sorted(map(str, map(tuple, out.select("doc_id", "source", "text", "n_lines", "n_dropped").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({L.SQL})").fetchall()
    assert got == sorted(map(str, want))
    assert sum(r[4] for r in want) > 200
