import re

import duckdb

from ticketlake.llm import linededup as L
from ticketlake.llm.queries import ORACLES, QUERIES

from .conftest import CLASHING, SF001, documents


def by_definition(rows):
    """Texts by position after dropping recurring lines."""
    def wording(line):
        return tuple(re.split("[ \t\r\f]+", re.sub("[^ \t\r\f]*[0-9][^ \t\r\f]*", "<*>", line.strip(L.BLANKS))))

    def templates(w):
        rest = len(w) - L.DEPTH
        strips = max(2 * L.SEGMENTS, 2 * -(-rest // L.FIELD))
        cuts = [L.DEPTH + rest * j // strips for j in range(strips + 1)]
        return [(j, len(w), w[:cuts[j]] + w[cuts[j + 2]:]) for j in range(strips - 1)] if len(w) >= L.GENERAL else []

    home, under = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else []:
            if len(wording(line)) >= L.SHORT:
                home[wording(line)] = min(i, home.get(wording(line), i))
    for w in home:
        for k in templates(w):
            under.setdefault(k, []).append(w)
    least = {k: min(home[w] for w in ws) for k, ws in under.items()}
    firm = {w for w in home if all(least[k] == home[w] for k in templates(w))}
    goes = {w for w in home if any(least[k] < home[w] and any(v in firm and home[v] == least[k] for v in under[k]) for k in templates(w))}
    out = []
    for i, t in rows:
        if i is not None and t is not None:
            t = "\n".join(x for x in t.split("\n") if wording(x) not in home or (home[wording(x)] == i and wording(x) not in goes))
        out.append((i, t))
    return out


ROWS = [(1, "keep this line here\nUser 17 logged in at 10:30 today\nThe end of one"),
        (2, "User 99 logged in at 11:45 today\nall of its own words\nHome"),
        (3, "Home\nthe order of anna smith was shipped to the main office on monday without any more delay\nx y z"),
        (4, "the order of anna smith was mailed from the main office on monday without any more delay\nx y z\n x  y z "),
        (5, "the order of nobody else came here by another road and never reached any office at all"),
        (6, "x y z"), (None, "x y z")]


def test_templates(spark):
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(documents(spark, ROWS)).collect()}
    assert got == dict(by_definition(ROWS))
    assert got[2] == "all of its own words\nHome"  # digits are a variable field; short lines stay
    assert got[4] == "" and got[6] == "" and got[None] == "x y z"  # one stretch differs; all lines gone; unnamed rows stay
    assert got[5] == ROWS[4][1]  # the same beginning alone is no template


def test_edge_rows(spark, edge_rows, edge_docs, no_docs):
    out = L.drop_recurring_lines(edge_docs)
    assert out.columns == [*edge_docs.columns, "n_lines", "n_dropped"]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.text) for r in out.collect()) == order(by_definition(edge_rows))
    assert all(r[c] == "x" for r in out.collect() for c in CLASHING)
    assert L.drop_recurring_lines(no_docs).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    want = sorted(con.execute(ORACLES["op8_line_dedup"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op8_line_dedup"](spark, SF001).collect()) == want


def test_native(spark):
    plan = QUERIES["op8_line_dedup"](spark, SF001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_of_one_id_lose_their_own_lines(spark):
    rows = [(1, "a line of boiler plate"), (2, "x of its own\na line of boiler plate"), (2, "a line of boiler plate\ny of its own")]
    got = sorted(r.text for r in L.drop_recurring_lines(documents(spark, rows)).where("doc_id = 2").collect())
    assert got == ["x of its own", "y of its own"]


WORDS = [f"{a}{b}" for a in "bcdfghjk" for b in ("an", "el", "ir", "os", "ut", "ay", "em", "il", "on", "ur")]


def changed(words, at, by):
    return " ".join([*words[:at], *by, *words[at + len(by):]])


def test_a_field_is_found_wherever_it_lies(spark):
    first = " ".join(WORDS)
    rows = [(1, first)] + [(2 + at, changed(WORDS, at, ["one", "other", "name"])) for at in range(L.DEPTH, len(WORDS) - 2)]
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(documents(spark, rows)).collect()}
    assert got == dict(by_definition(rows)) == {i: first if i == 1 else "" for i, _ in rows}


def test_chains_and_unique_stretches_keep_their_words(spark):
    chain = [(1, " ".join(WORDS)), (2, changed(WORDS, 20, ["one", "two"])),
             (3, changed(changed(WORDS, 20, ["one", "two"]).split(), 60, ["three", "four"]))]
    long = [(4, "start of it " + " ".join(WORDS)), (5, "start of it " + changed(WORDS, 30, [f"own{w}" for w in WORDS[:20]]))]
    for rows in (chain, long, chain + long):
        got = dict((r.doc_id, r.text) for r in L.drop_recurring_lines(documents(spark, rows)).collect())
        assert got == dict(by_definition(rows))
    assert got[1] == chain[0][1] and got[2] == ""
    assert got[3] == chain[2][1]  # its only template leads to a line that goes
    assert got[4] == long[0][1] and got[5] == long[1][1]  # 20 words of its own are no field


def test_lost_words_are_bounded(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    kept = {r.doc_id: r.text for r in L.drop_recurring_lines(documents(spark, rows)).collect()}
    assert kept == dict(by_definition(rows))
    stay = {}
    for t in kept.values():
        for line in (t or "").split("\n"):
            w = re.split("[ \t\r\f]+", re.sub("[^ \t\r\f]*[0-9][^ \t\r\f]*", "<*>", line.strip(L.BLANKS)))
            stay.setdefault((len(w), *w[:L.DEPTH]), []).append(w)
    for i, t in rows:
        left = (kept[i] or "").split("\n")
        for line in (t or "").split("\n"):
            if line not in left:
                w = re.split("[ \t\r\f]+", re.sub("[^ \t\r\f]*[0-9][^ \t\r\f]*", "<*>", line.strip(L.BLANKS)))
                assert min(sum(x != y for x, y in zip(w, v, strict=True)) for v in stay[(len(w), *w[:L.DEPTH])]) <= L.FIELD


def test_many_lines_in_one_text(spark):
    text = "\n".join(f"line {w} has words of its own {v}" for w in WORDS for v in WORDS * 10)
    got = {r.doc_id: r.n_dropped for r in L.drop_recurring_lines(documents(spark, [(1, text), (2, text + "\nlast line of two")])).collect()}
    assert got == {1: 0, 2: 64000}
