"""The jobs: runs over growing input, repeated runs, runs that died, and their queries against SQL."""

import re
import shutil
from collections import Counter

import pytest
from oracle import DATA, connect, same_rows

from jobs import code_report, queries, search_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, rows):
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def index_of(spark, place):
    return sorted((x.doc_id, x.token, x.n) for x in search_index.current(spark, f"{place}/index").collect())


def plain(docs):
    return sorted((k, w, n) for k, t in docs.items() for w, n in Counter(re.findall(r"[^\W_]+", (t or "").lower())).items())


def run(spark, place, **how):
    return search_index.run(spark, f"{place}/in", f"{place}/index", f"{place}/checkpoint", **how)


def test_index_of_growing_input(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, "One two two"), (2, "two, THREE"), (3, None), (None, "lost")])
    assert run(spark, tmp_path) == 1 and run(spark, tmp_path) == 0
    docs = {1: "One two two", 2: "two, THREE", 3: None}
    assert index_of(spark, tmp_path) == plain(docs)
    before = {p for p in (tmp_path / "index").rglob("*.parquet")}
    # a changed text, the same text again, a text taken out, a new one
    put(spark, tmp_path / "in", [(1, "one four"), (2, "two, THREE"), (4, "new")])
    put(spark, tmp_path / "in", [(4, "newer"), (2, "")])
    assert run(spark, tmp_path, files_per_batch=1) == 2
    docs |= {1: "one four", 2: "", 4: "newer"}
    assert index_of(spark, tmp_path) == plain(docs)
    assert before <= {p for p in (tmp_path / "index").rglob("*.parquet")}  # what was written is not written again
    assert [x.doc_id for x in search_index.find(spark, f"{tmp_path}/index", "ONE four").collect()] == [1]
    assert search_index.find(spark, f"{tmp_path}/index", "two").count() == 0 == search_index.find(spark, f"{tmp_path}/index", " ,").count()
    assert {x.doc_id: x.n_tokens for x in search_index.versions(spark, f"{tmp_path}/index").collect()} == {1: 2, 2: 0, 3: 0, 4: 1}


def test_index_after_a_run_that_died(spark, tmp_path, monkeypatch):
    """A run that ends between its two writes is repeated with the same files and gives the same index."""
    put(spark, tmp_path / "in", [(k, f"text {k} of {k % 3}") for k in range(20)])
    write = search_index._write
    monkeypatch.setattr(search_index, "_write", lambda rows, path, *parts: write(rows, path, *parts) if "batch" != parts[-1] else 1 / 0)
    with pytest.raises(Exception, match="division by zero|ZeroDivision"):
        run(spark, tmp_path)
    assert search_index.current(spark, f"{tmp_path}/index").count() == 0  # postings without a version don't count
    monkeypatch.undo()
    put(spark, tmp_path / "in", [(3, "changed")])
    assert run(spark, tmp_path) == 2
    assert index_of(spark, tmp_path) == plain({k: f"text {k} of {k % 3}" for k in range(20)} | {3: "changed"})


def test_index_of_one_batch_with_repeated_ids(spark, tmp_path):
    """The newest file decides, in a file the greatest text; a third of all rows with one id are one document."""
    put(spark, tmp_path / "in", [(7, f"a{k}") for k in range(100)] + [(k, "x") for k in range(200, 300)])
    put(spark, tmp_path / "in", [(7, "last")])
    run(spark, tmp_path)
    assert index_of(spark, tmp_path) == plain({7: "last"} | dict.fromkeys(range(200, 300), "x"))
    shutil.rmtree(tmp_path / "index")
    assert search_index.versions(spark, f"{tmp_path}/index").count() == 0


def test_postings_are_counted_once_and_joined_without_a_sort(spark, tmp_path, monkeypatch):
    """Ranges would have all words counted once more for their sample; the answer must not sort all postings."""
    put(spark, tmp_path / "in", [(k, f"text {k}") for k in range(50)])
    plans, write = [], search_index._write
    monkeypatch.setattr(search_index, "_write", lambda rows, path, *parts: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, path, *parts))
    assert run(spark, tmp_path) == 1
    assert len(plans) == 2 and not any("rangepartitioning" in p for p in plans)
    assert "SortMergeJoin" not in search_index.current(spark, f"{tmp_path}/index")._jdf.queryExecution().executedPlan().toString()
    assert index_of(spark, tmp_path) == plain({k: f"text {k}" for k in range(50)})


def test_report_again_and_beside_others(spark, tmp_path):
    place = str(tmp_path / "report")
    files = {"a/m.py": "def f():\n    return g()\n\ndef g():\n    print(1)\n", "tests/test_m.py": "from a.m import f\n\ndef test_f():\n    assert f()\n", "a/n.py": "def h():\n    gone()\n"}
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "file_path string, source string")
    rows = lambda label=None: sorted(tuple(x) for x in code_report.report(spark, place, label).collect())
    assert code_report.run(spark, frame(files), place, "one") == {"dead": 2, "untested": 1, "used": 1, "unresolved": 2}
    first = rows()
    assert ("one", "dead", "a/", "a/n.py::h", 1) in first and ("one", "untested", "a/", "a/n.py::h", 1) in first and ("one", "used", "a/", "a/m.py", 2) in first
    assert {x[3]: x[4] for x in first if x[1] == "unresolved"} == {"print": 1, "gone": 1} and {x[3]: x[4] for x in first if x[1] == "total"} == {"dead": 2, "untested": 1, "used": 1, "unresolved": 2}
    code_report.run(spark, frame(files), place, "one")
    assert rows() == first
    files["a/n.py"] = "LIMIT = 1\n"
    code_report.run(spark, frame(files), place, "two")
    assert rows("one") == first and not [x for x in rows("two") if x[3] == "a/n.py::h"]
    code_report.run(spark, frame(files), place, "one")  # what the earlier run of the label wrote is gone
    assert [x[1:] for x in rows("one")] == [x[1:] for x in rows("two")]


def test_command_lines(tmp_path):
    for job in (search_index, code_report):
        with pytest.raises(SystemExit):
            job.main([])
    settings = tmp_path / "x.toml"
    settings.write_text('output = "o"\nlabel = "l"\n')
    with pytest.raises(SystemExit):
        code_report.main(["--config", str(settings), "--tables", "a", "--tree", "b"])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    keys = ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    same_rows(spark, connect(), queries.QUERIES[name], queries.ORACLE[name])
    assert [spark.conf.get(k) for k in keys] == before
