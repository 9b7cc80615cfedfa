"""Large groups of edited copies, against all pairs."""

import numpy as np

from workload_lens.llm import near_duplicates


def variants(make, name, n, length, edits):
    base = [f"{name}{i}" for i in range(length)]
    out = []
    for k in range(n):
        own = list(base)
        for at in make.choice(length, edits, replace=False):
            own[at] = f"{name}edit{k}x{at}"
        out.append(" ".join(own))
    return " ".join(base), out


def brute_force(texts, idf):
    """The class of each text from the exact similarity of all pairs; the texts repeat no shingle."""
    bags = [near_duplicates.shingles(t) for t in texts]
    every, count = np.unique(np.concatenate(bags), return_counts=True)
    often = every[count > 1]
    table = np.zeros((len(bags), len(often)))
    for i, bag in enumerate(bags):
        table[i, np.searchsorted(often, bag[np.isin(bag, often)])] = 1
    weight = idf[near_duplicates._bin(often)].astype(float)
    total = np.array([idf[near_duplicates._bin(b)].astype(float).sum() for b in bags])
    classes = np.arange(len(bags))
    for i in range(len(bags)):
        shared = (table[i] * weight) @ table.T
        for j in np.flatnonzero(shared >= 0.8 * (total[i] + total - shared)):
            if classes[i] != classes[j]:
                low, high = sorted((classes[i], classes[j]))
                classes[classes == high] = low
    return classes.tolist()


def test_copies_around_one_original_are_one_class(spark):
    make = np.random.default_rng(0)
    original, texts = variants(make, "w", 2000, 200, 3)
    texts.insert(1000, original)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_force(texts, near_duplicates.idf_weights(docs))
    assert len(set(expected)) < 100  # a few variants lie apart: their edits spread over more shingles, by weight
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_members_that_no_representative_joins_are_compared(spark, monkeypatch):
    """Pairs of twins within copies that are apart from each other and from all others."""
    make = np.random.default_rng(7)
    _, texts = variants(make, "w", 300, 200, 4)
    texts += [t.replace("w100 ", "twin ", 1) for t in texts[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_force(texts, near_duplicates.idf_weights(docs))
    assert len(set(expected)) > 100
    monkeypatch.setattr(near_duplicates, "BLOCK", 16, raising=False)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_members_of_a_crowd_meet_their_shingles_once(spark, monkeypatch):
    """What blocks are compared from has a row for each two blocks, not one for each member of them."""
    make = np.random.default_rng(3)
    _, texts = variants(make, "w", 96, 40, 3)
    bags = [np.sort(near_duplicates.shingles(t)).tobytes() for t in texts]
    names = [f"{i:02}".encode() for i in range(len(texts))]
    place = spark.createDataFrame([(1, n, n) for n in names], "bucket long, node binary, comp binary")
    table = spark.createDataFrame(list(zip(names, bags, strict=True)), "node binary, bag binary")
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    compared = []
    arrow = type(place).mapInArrow
    monkeypatch.setattr(type(place), "mapInArrow", lambda df, *a, **k: compared.append(df) or arrow(df, *a, **k))
    idf = np.ones(near_duplicates.BINS, np.float32)
    links = {(bytes(r["a"]), bytes(r["b"])) for r in near_duplicates._rest(place, table, idf, 0.6).collect()}
    assert compared[-1].count() == 6 * 6  # 6 blocks alone, and 15 pairs of 2
    near = {(names[i], names[j]) for i in range(96) for j in range(i) if near_duplicates._similar(bags[i], bags[j], idf) >= 0.6}
    assert links <= near and {n for pair in links for n in pair} == {n for pair in near for n in pair}
