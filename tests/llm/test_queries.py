import glob
import os

import duckdb
import pytest

from cuemill.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")

KEYS = {
    "p1_found": ["scene_id", "og_line", "en_line"], "p3_found": ["scene_id", "field_name"], "p3_verdicts": ["scene_id", "field_name"], "p4_found": ["table_name", "record_id", "field_name"], "p4_sources": ["table_name", "source"], "p5_found": ["segment_name", "first_pos"],
    "p5_runs": ["segment_name", "first_pos"], "p5_exact": ["segment_name", "first_pos"], "p6_ids": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p7_items": ["item_id"], "p8_found": ["doc_id", "from_char"], "p8_share": ["doc_id"],
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def results(spark):
    return {name: [r.asDict() for r in query(spark, SF).collect()] for name, query in catalog.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_keys_are_unique_and_known(results, name):
    rows = results[name]
    keys = [tuple(r[k] for k in KEYS[name]) for r in rows]
    assert rows and len(set(keys)) == len(keys) and all(None not in k[:1] for k in keys)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_gives_the_same_rows(results, db, name):
    cols = sorted(results[name][0])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    r = db.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert sorted(names) == cols and sorted((tuple(norm(x[c]) for c in cols) for x in results[name]), key=str) == want


def test_results_agree_with_each_other(results, db):
    """Runs of several cues, fields with a verdict, items and shares are the same in the queries that count them."""
    long = {(r["segment_name"], r["first_pos"], r["last_pos"]) for r in results["p5_runs"] if r["n_cues"] > 1}
    assert long == {tuple(r[k] for k in ("segment_name", "first_pos", "last_pos")) for r in results["p5_found"]}
    bad = {(r["scene_id"], r["field_name"]) for r in results["p3_found"]}
    assert bad == {(r["scene_id"], r["field_name"]) for r in results["p3_verdicts"]}
    assert not bad & {(r["record_id"], r["field_name"]) for r in results["p4_found"] if r["table_name"] == "scene"}
    assert sum(r["n_docs"] for r in results["p7_items"]) == len(results["p7_found"])
    cut = sum(r["n_cut"] for r in results["p4_sources"])
    assert cut == len(results["p4_found"]) and all(0 <= r["cut_share"] <= 1 for r in results["p4_sources"])
    docs = db.execute("select count(*), count(*) filter (where coalesce(text, '') = '') from documents").fetchone()
    assert (len(results["p6_ids"]), sum(not r["ids"] for r in results["p6_ids"])) == docs


def test_aligned_lines_stand_in_their_texts(results, db):
    text = {i: (og, en) for i, og, en in db.execute("select distinct scene_id, reference_lyrics_og, reference_lyrics_en from scene").fetchall()}
    from cuemill.llm.bilingual import lines_of

    for r in results["p1_found"]:
        og, en = map(lines_of, text[r["scene_id"]])
        assert r["og_line"] < len(og) and r["en_line"] < len(en)
