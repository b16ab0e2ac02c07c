"""Each stage against brute force over what its predecessor kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import SF, brute_items, brute_repeats, odd_rows, plain_discriminant, rows_of, shingle_set, whole_ids
from veilframe.llm.queries import table


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).persist()
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert all(s.schema.names == stages[0].schema.names for s in stages[:-1])


def test_quality_decides(spark, stages):
    pairs = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect()]
    said = plain_discriminant(rows_of(stages[0]), pairs)
    assert {r.doc_id for r in stages[1].collect()} == {d for d, p in said if p >= 0.5}


def test_one_of_each_group_stays(stages):
    own = {r.doc_id: shingle_set(r.text or "") for r in stages[1].collect()}
    ids, parent = sorted(own), {d: d for d in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in stages[2].collect()) == [d for d in ids if find(d) == d]


def test_passages_are_cut(stages):
    own = [(r.doc_id, r.text or "") for r in stages[2].collect()]
    want = {}
    for i, (b, g) in brute_repeats(own).items():
        kept, at = "", 0
        for c in own[i][1]:
            n = len(c.encode())
            kept += "" if all(g[at : at + n]) else c
            at += n
        if kept.strip() or not any(g):
            want[own[i][0]] = kept
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}


def test_contaminated_go_and_the_rest_is_packed(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, t in rows_of(stages[3]) if brute_items(t, items)}
    left = {r.doc_id: r.text for r in stages[4].collect()}
    assert set(left) == {r.doc_id for r in stages[3].collect()} - bad
    length, bins = defaultdict(int), defaultdict(int)
    for r in stages[5].collect():
        length[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert dict(length) == {d: len(x) + 1 for d, x in zip(left, whole_ids(list(left.values())), strict=True)}
    assert max(bins.values()) <= 1024


CLASHES = ("id", "c0", "block_id", "nth", "cls", "content", "digest", "part", "rest", "payload", "score", "length", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with columns that bear the operators' own names, and an item inside one text."""
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(i, t, "xx", None if k % 4 else "src", len(t) if t else None, *(f"{c}{k}" for c in CLASHES)) for k, (i, t, _, _) in enumerate([*odd_rows(), (400, f"before {item} after", "", "")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3).persist()


def test_odd_rows_through_the_quality_stage(spark, odd):
    said = plain_discriminant(rows_of(odd), [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect() if any(r.doc_id == x.doc_id for x in odd.collect())])
    kept = corpus_pipeline.keep_quality(spark, odd, SF)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, p in said if p >= 0.5)


def test_odd_rows_through_the_join_stage(spark, odd):
    own = odd.collect()
    sets, parent = [shingle_set(r.text or "") for r in own], list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(own):
        groups[find(i)].append(r)
    got = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert not Counter(map(tuple, got)) - Counter(map(tuple, own)) and len(got) == len(groups)
    by = {tuple(r)[5:]: r for r in got}  # the clashing columns number the rows
    for rows in groups.values():
        (kept,) = [by[tuple(r)[5:]] for r in rows if tuple(r)[5:] in by]
        assert kept.doc_id == min((r.doc_id for r in rows if r.doc_id is not None), default=None)


def test_a_copy_goes_whatever_else_bears_its_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(3, b), (7, a), (7, b), (9, a), (None, b), (None, "c " * 9)], "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())) == Counter([(3, b), (7, a), (None, "c " * 9)])


def test_odd_rows_through_the_dedup_stage(spark, odd):
    own = odd.collect()
    got = corpus_pipeline.cut_repeated_passages(spark, odd, SF)
    assert got.columns == odd.columns
    by = {tuple(r)[5:]: r for r in got.collect()}
    repeated = {d for d, n in Counter(r.doc_id for r in own).items() if n > 1}
    for i, (_, g) in brute_repeats([(r.doc_id, r.text or "") for r in own]).items():
        r, at, kept = own[i], 0, ""
        if r.doc_id in repeated:
            continue  # the order of rows that share an id is the order they are staged in
        for c in r.text or "":
            n = len(c.encode())
            kept += "" if all(g[at : at + n]) else c
            at += n
        if any(g) and not kept.strip():
            assert tuple(r)[5:] not in by
        else:
            assert by[tuple(r)[5:]].text == (None if r.text is None else kept)
            assert by[tuple(r)[5:]].n_chars == (None if r.text is None else len(kept))


def test_odd_rows_through_the_last_stages(spark, odd):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = corpus_pipeline.drop_contaminated(spark, odd, SF)
    assert clean.columns == odd.columns
    want = [r for r in odd.collect() if not brute_items(r.text, items)]
    assert Counter(map(tuple, clean.collect())) == Counter(map(tuple, want)) and 400 not in {r.doc_id for r in want}
    length = Counter()
    for r in corpus_pipeline.pack_sequences(spark, odd, SF).collect():
        length[r.doc_id] += r.length
    own = odd.collect()
    sizes = Counter()
    for r, x in zip(own, whole_ids([r.text or "" for r in own]), strict=True):
        sizes[r.doc_id] += len(x) + 1
    assert length == sizes


def test_an_empty_table_passes_through(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))
