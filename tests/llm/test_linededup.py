import random
from collections import Counter, defaultdict

from helixlake.llm import linededup as ld


def brute(rows, min_docs):
    """The module's rules in plain loops; rows are (doc_id, text), equal rows once."""
    rows = list(dict.fromkeys(rows))
    occ = []
    for r, (_, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            tokens = ld.tokens_of(line)
            if tokens:
                occ.append((r, k, ld.leaf_of(tokens), tuple(tokens)))
    leaf_docs = defaultdict(set)
    for r, _, leaf, _ in occ:
        leaf_docs[leaf].add(r)
    occ = [o for o in occ if len(leaf_docs[o[2]]) >= min_docs]
    several = defaultdict(set)
    for _, _, leaf, tokens in occ:
        several[leaf].add(tokens)
    support = Counter((leaf, i, t) for _, _, leaf, tokens in occ for i, t in enumerate(tokens))
    docs, made = defaultdict(set), {}
    for r, k, leaf, tokens in occ:
        own = list(tokens)
        if len(several[leaf]) > 1:
            own = [ld.FIELD if i >= ld.DEPTH and support[leaf, i, t] < min_docs else t for i, t in enumerate(tokens)]
        constant = sum(t != ld.FIELD for t in own)
        if constant < ld.MIN_CONSTANT or constant < ld.SHARE * len(own):
            own = tokens
        made[r, k] = " ".join(own) if own is not tokens else "= " + " ".join(tokens)
        docs[made[r, k]].add(r)
    long = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(line.split()) > ld.LONG:
                long[" ".join(line.split())].add(r)
    out = {}
    for r, row in enumerate(rows):
        gone = set()
        for k, line in enumerate((row[1] or "").split("\n")):
            have = long.get(" ".join(line.split()), ())
            if len(have) >= ld.LONG_DOCS and min(have, key=lambda x: (rows[x][0] is None, rows[x][0] or 0)) != r:
                gone.add(k)
        for k in range(len((row[1] or "").split("\n"))):
            t = made.get((r, k))
            if t and len(docs[t]) >= min_docs:
                first = min(docs[t], key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
                if first != r:
                    gone.add(k)
        out[row] = (row[1] if row[1] is None else "\n".join(x for k, x in enumerate(row[1].split("\n")) if k not in gone), len(gone))
    return out


def test_matches_plain_loops(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnop"]
    rows = []
    for i in range(120):
        lines = [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(r.randint(0, 5))]
        if r.random() < 0.5:
            lines.append(f"served by host{r.randint(1, 99)} for user {r.choice(words)} in room {r.choice(words[:3])} today ok")
        if r.random() < 0.3:
            lines.append("all rights are reserved here")
        if r.random() < 0.2:
            lines.append("a b c")
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (3, rows[3][1]), (202, "all rights are reserved here\n" * 3000)]
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, leaf string").repartition(7)
    want = brute(rows, ld.MIN_DOCS)
    out = ld.dedup(table, count="n_dropped").collect()
    assert len(out) == len(rows)
    kept = Counter((x.doc_id, x.text, x.n_dropped) for x in out)
    assert kept == Counter((i, *want[i, t]) for i, t in rows)
    assert sum(x.n_dropped for x in out) > 3000 and len({x.doc_id for x in out if x.text and "all rights" in x.text}) == 1
    assert any("served by" in (x.text or "") for x in out)
    assert len({x.doc_id for x in out if "a b c" in (x.text or "").split("\n")}) == 1


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ld.dedup(empty).count() == 0 and ld.dedup(empty).columns == empty.columns
    same = spark.createDataFrame([(None, "one two three four five")] * 9 + [(None, None)], "doc_id long, text string")
    assert sorted(x.text or "" for x in ld.dedup(same).collect()) == [""] + ["one two three four five"] * 9
