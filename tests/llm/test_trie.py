import hashlib
import zlib
from collections import defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from trackframe.llm import trie
from trackframe.llm.trie import prefix_trie, turns_of, with_shared_starts

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, depth int, rn int, size int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], SCHEMA)


def sha(data):
    return hashlib.sha256(data).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role.encode())}:{role}{text}".encode())
            own[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [t for _, _, t in sorted(v, key=lambda v: v[:2])] for c, v in own.items()}
    found = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        found[c] = turns.get(base, [])[:h] + turns[c][h:]
    return found


def by_hand(paths):
    """The definition: members of every prefix, and a walk over each subtree."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, found = [node], []
        while todo:
            at = todo.pop()
            found.append(at)
            todo += children[at]
        return found

    result = set()
    for node, own in members.items():
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        result.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            len(children[node]), sum(not children[v] for v in under),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in under if v),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return result


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def of(spark, rows, **sizes):
    return found(prefix_trie(with_shared_starts(turns_of(table(spark, rows))), **sizes))


def conversations(seed, count=120, most=14, said=3):
    """Few different turns, so that many conversations share their first ones."""
    rng = Random(seed)
    rows = []
    for c in rng.sample(range(-20, 2 * count), count):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), f"é{rng.randrange(said)}" * (t + 1)))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_equals_the_definition(spark, block):
    rows = conversations(block)
    # copies of one conversation, and one far longer than the rest
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(9)]
    rows += [(2003, t, "user", f"same {t}") for t in range(70)]
    assert of(spark, rows, block_turns=block, ids_per_text=3) == by_hand(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [
        (0, None, None, None), (0, 0, "a", "b"), (0, 0, "a", "b"), (0, 0, "ab", ""), (0, 0, "", "ab"),
        (1, 3, "user", None), (2, None, "", ""), (7, 1, "user", "x" * 100_000), (7, 1, "user", "y"),
        (None, 1, "user", "nobody"), (None, None, None, None), (10, 5, "1:a", "b"), (10, -5, "a", "b"),
        (-3, 1, "user", "z"), (-5, 1, "user", "z"), (-5, None, "user", "z"),
    ]
    assert of(spark, rows) == by_hand(rebuilt(rows))


def test_conversation_without_turns_belongs_to_the_root_only(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone")]
    root, = of(spark, rows)
    assert root[:7] == (c, 0, None, 1, 0, 1, 0)
    assert root[7] == hashlib.sha256(str(c).encode()).hexdigest()


def test_empty_table(spark):
    assert of(spark, []) == set()


def test_only_blocks_with_siblings_are_looked_into(spark):
    """A node's rows are put together only where its parent has several blocks."""
    rows = [(c, t, "user", f"{c if t > 20 else 0} {t}") for c in (5, 10) for t in range(40)]
    turns = turns_of(table(spark, rows)).unionByName(
        spark.createDataFrame([(5, 0), (10, 0)], "conv_id long, rn int")
        .withColumns({"digest": F.lit(None).cast("binary"), "size": F.lit(0).cast("long")})
    )
    blocks = trie._distinct_blocks(trie.blocks_of(turns))
    state = {(r["k"], r["conv_id"]): (r["n"], r["single"]) for r in blocks.collect()}
    assert state == {
        (0, 5): (2, True), (1, 5): (2, True), (2, 5): (1, False), (2, 10): (1, False),
        (3, 5): (1, True), (3, 10): (1, True), (4, 5): (1, True), (4, 10): (1, True),
    }
