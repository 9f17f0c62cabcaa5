"""Operator 3: exact round trip of conversations through the trees, and its edge cases."""

from collections import defaultdict

from lattica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """conversation -> tokens, positions and visible tokens by following the nodes, with the trees checked."""
    nodes = {r.node: r for r in rows}
    assert sorted(nodes) == list(range(len(nodes)))
    trees = defaultdict(list)
    for n in sorted(nodes):
        trees[nodes[n].tree_id].append(nodes[n])
    out = {}
    for tree in trees.values():
        at, flat, seen = 0, [], []
        for r in tree:
            assert r.start == at
            at += len(r.tokens)
            flat += r.tokens
            # Depth first: the parent is the nearest earlier node one level up.
            up = [q for q in seen if q.depth == r.depth - 1]
            assert r.parent == (up[-1].node if r.depth > 1 else None)
            seen.append(r)
        for r in tree:
            chain, q = [r], r
            while q.parent is not None:
                q = nodes[q.parent]
                chain.insert(0, q)
            path = [t for q in chain for t in q.tokens]
            visible = [t for i in r.attends for t in flat[i["from"] : i["to"]]]
            assert visible == [t for q in chain[:-1] for t in q.tokens]
            assert r.position == len(visible)
            assert all(a["to"] < b["from"] for a, b in zip(r.attends, r.attends[1:]))
            for c in r.ends:
                out[c] = path
    return out


def test_round_trip(spark):
    rows = []
    for c in range(60):
        rows.append((c, 0, "system", f"Système {c % 2}"))
        rows.append((c, 1, "user", f"question {c % 6}"))
        rows += [(c, 2 + k, "assistant" if k % 2 == 0 else "user", f"reply {c % 12} {k}") for k in range(c % 4)]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(rows):
        want[c] += chat.turn_tokens(role, text)
    assert rebuilt(got) == dict(want)
    assert len({r.tree_id for r in got}) == 2
    distinct = {tuple(sorted((t, r, x) for q, t, r, x in rows if q == c and t <= k)) for c, k, _, _ in rows}
    assert len(got) == len(distinct)


def test_edge_cases(spark):
    long = "very long text " * 30_000
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (1, 3, "user", ""),
        (2, 0, "user", "hi"), (None, 0, "user", "nobody's"), (3, 0, "robot", long), (4, 5, "user", "hi"), (4, 5, "user", "ho"),
    ]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], SCHEMA + ", node int, path string")
    got = rebuilt(chat.format_chats(df).collect())
    hi = chat.turn_tokens("user", "hi")
    assert got[1] == hi + chat.turn_tokens("user", "") + chat.turn_tokens(None, None)
    assert got[2] == hi
    assert got[3] == chat.turn_tokens("robot", long)
    assert sorted([got[4]]) == sorted([got[4]]) and len(got[4]) == len(hi) + len(chat.turn_tokens("user", "ho"))
    assert set(got) == {1, 2, 3, 4}
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = rebuilt(chat.query(spark, sf).collect())
    want = defaultdict(list)
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id] += chat.turn_tokens(r.role, r.text)
    assert got == dict(want)


def test_walk_goes_on_over_parts(spark):
    """Many parts, nodes open over several of them: numbers, counts and intervals as by brute force."""
    rows = []
    for c in range(120):
        rows += [(c, 0, "system", "one prompt for all"), (c, 1, "user", f"q {c % 3}")]
        rows += [(c, 2 + k, "user", f"{k} {c % 5}") for k in range(c % 4)]
        rows += [(c, 9, "user", f"own {c}")] * (c % 2)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = chat.format_chats(df).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    paths, want = defaultdict(list), defaultdict(list)
    for c, _, role, text in sorted(rows):
        paths[c].append((role, text))
        want[c] += chat.turn_tokens(role, text)
    assert rebuilt(got) == dict(want)
    passes = defaultdict(int)
    for p in paths.values():
        for k in range(len(p)):
            passes[tuple(p[: k + 1])] += 1
    nodes = {r.node: r for r in got}

    def turns(r):
        return (*(turns(nodes[r.parent]) if r.parent is not None else ()), tuple(r.tokens))

    named = {tuple(tuple(chat.turn_tokens(*x)) for x in p): n for p, n in passes.items()}
    assert {turns(r): r.conversations for r in got} == named
    assert sorted(c for r in got for c in r.ends) == list(range(120))


def test_many_turns_and_a_prompt_of_many_conversations(spark):
    long = spark.range(20_000).selectExpr("1L conv_id", "id turn", "'user' role", "cast(id % 7 as string) text")
    wide = spark.range(60_000).selectExpr("id + 2 conv_id", "explode(sequence(0, 1)) turn", "'user' role", "id").selectExpr("conv_id", "cast(turn as long) turn", "role", "if(turn = 0, 'prompt', concat('q ', id)) text")
    got = chat.format_chats(long.unionByName(wide)).select("tree_id", "node", "depth", "conversations", "start", "position", "attends", "ends").toPandas()
    chain = got[got.depth > 2].sort_values("depth")
    assert list(chain.depth) == list(range(3, 20_001)) and (chain.start == chain.position).all()
    assert all(len(a) == 1 and a[0]["from"] == 0 and a[0]["to"] == s for a, s in zip(chain.attends, chain.start))
    root = got[(got.depth == 1) & (got.conversations > 1)]
    assert list(root.conversations) == [60_000] and len(got) == 20_000 + 60_001
    assert sorted(got.node) == list(range(80_001))
