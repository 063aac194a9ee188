"""Near duplicates of the given documents against all pairs: every link is found, none is invented."""

from nextbuy.llm.minhash import near_duplicates

from . import plain


def test_all_pairs_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, words = {}, 2
    for r in docs.collect():
        w = [x for x in plain.lower("".join(" " if c in plain.WS else c for c in r.text or "")).split(" ") if x]
        sets[r.doc_id] = {tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    n_links = 0
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if 100 * len(sets[i]) < 80 * len(sets[j]):
                break  # all further ones are larger
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                n_links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert n_links > 50
    want = {i: (len(s), root(i)) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, words=words).collect()}
    assert got == want
