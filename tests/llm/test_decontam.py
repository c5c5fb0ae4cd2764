import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlake.llm import decontam as D

from .conftest import documents, words


def least_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, ch in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j + 1)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=150))
def test_myers_equals_dynamic_program(pattern, text):
    d, end = least_distance(pattern, text)
    got = D.best_end(D.masks_of(pattern), len(pattern), text, len(pattern) - 1)
    assert got == ((d, end) if d < len(pattern) else None)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_every_match_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    item = " ".join(words(rng, 25))
    edits = int(len(item) * D.RATE)
    passage = list(item)
    for _ in range(rng.randint(0, edits + 3)):
        k = rng.randrange(len(passage))
        rng.choice([lambda: passage.pop(k), lambda: passage.insert(k, "x"), lambda: passage.__setitem__(k, "y")])()
    text = D.normal(" ".join(words(rng, 40)) + " " + "".join(passage) + " " + " ".join(words(rng, 40)))
    want, _ = least_distance(D.normal(item), text)
    got = D.Matcher(((1, item),), D.RATE).matches(text)
    assert (got[0][1] if got else None) == (want if want <= edits else None)
    for _, d, a, b in got:
        assert least_distance(D.normal(item), text[a:b])[0] == d


def test_edge_rows_and_blocks(spark, edge_rows, edge_docs, no_docs):
    rng = random.Random(9)
    item = " ".join(words(rng, 30))
    rows = [*edge_rows, (50, "before\n" + item.upper().replace(" ", "\n\t") + " after"), (51, item[:60])]
    docs = documents(spark, rows)
    schema = "item_id long, text string, extra string"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (1, item, "x"), (None, "zzz qqq", "x"),
                                   (7, "one", "x")], schema)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in D.find_contamination(docs, bench).collect())
    assert got == [(7, 7, 0), (50, 1, 0), (50, 1, 0)]
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in (7, 50))
    assert len(list(D.item_blocks(bench, chars=60))) > 1
    assert D.find_contamination(no_docs, bench).collect() == []
    assert D.find_contamination(docs, bench.limit(0)).collect() == []
    assert D.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_give_what_one_block_gives(spark, edge_rows):
    rng = random.Random(12)
    items = [" ".join(words(rng, 20)) for _ in range(6)] + ["one", "tiny item"]
    rows = [*edge_rows, *[(100 + i, " ".join(words(rng, 30)) + " " + t + " " + " ".join(words(rng, 30))) for i, t in enumerate(items)],
            (300, " ".join(words(rng, 80))), (301, "tiny item!"), (None, items[0])]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(D.find_contamination(docs, bench, block_chars=150)) == key(D.find_contamination(docs, bench))
    kept = D.drop_contaminated(docs, bench, block_chars=150)
    assert kept.columns == docs.columns and key(kept) == key(D.drop_contaminated(docs, bench))
    # Short items are reported, and drop no text on their own that is much more than they are.
    ids = {r.doc_id for r in kept.collect()}
    assert {106, 107, 300} <= ids and not {100, 101, 102, 103, 104, 105, 301, 7} & ids
    assert {106, 107, 301} <= {r.doc_id for r in D.find_contamination(docs, bench).where("item_id >= 6").collect()}
