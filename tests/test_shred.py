import json

from sheafline.operators import shred


def node(i, *kids, **more):
    return {"id": f"section_{i}", "type": "section", "children": list(kids), **more}


def payload(root, **more):
    return json.dumps({"structure": {"root": root}, **more})


def test_levels():
    tree = {"id": "doc_0", "type": "document", "children": [node(1, node(3), node(4)), node(2), {"id": "c", "type": "chunk"}]}
    got = [s[:5] for s in shred.stripes_of(payload(tree))]
    assert got == [
        (0, 0, 0, 0, "doc_0"),
        (1, 0, 0, 1, "section_1"), (1, 1, 1, 1, "section_2"), (1, 2, 1, 1, "c"),
        (2, 0, 0, 2, "section_3"), (2, 1, 2, 2, "section_4"), (2, 2, 1, 1, None), (2, 3, 1, 1, None),
    ]


def test_levels_of_leaves():
    tree = node(0, node(1, title="t", bounding_box=[1, 2, 3, 4]), node(2, page=7, bounding_box=[1]), node(3, node(4)))
    got = {s[4]: (s[7], s[9], s[11], s[10]) for s in shred.stripes_of(payload(tree)) if s[4]}
    assert got == {"section_0": (0, 0, 0, None), "section_1": (2, 1, 3, [1, 2, 3, 4]), "section_2": (1, 2, 2, None), "section_3": (1, 1, 1, None), "section_4": (2, 2, 2, None)}


def test_round_trip(spark):
    import random

    rng = random.Random(4)
    count = iter(range(10**6))

    def grow(depth):
        kids = [grow(depth + 1) for _ in range(rng.randrange(4))] if depth < 6 else []
        n = {"id": f"n{next(count)}", "type": "section", "bounding_box": rng.choice([[1, 2, 3, 4], ["5", "6", "7", "8"], {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "9 8 7 6", "1,2,3,4", None, [1, 2]])}
        if kids or rng.random() < 0.5:
            n["children"] = json.dumps(kids) if kids and rng.random() < 0.2 else kids
        return n

    rows, want = [], set()

    def walk(d, n):
        for i, k in enumerate(shred.as_nodes(n.get("children"))):
            want.add((d, k["id"], n["id"], i, shred.box_text(k.get("bounding_box"))))
            walk(d, k)

    for d in range(30):
        tree = grow(0)
        walk(f"d{d}", tree)
        rows += [(f"d{d}", payload(tree))] * (1 + d % 2)
    df = spark.createDataFrame(rows + [("cut", rows[0][1][:-5]), ("null", None), ("empty", ""), (None, "{}"), ("list", "[]"), ("text", '"x"')], "doc_id string, payload string")
    assert {tuple(r) for r in shred.found(df).collect()} == want
    flat = shred.flat_nodes(df).collect()
    assert len(flat) == len(want) and {r["depth"] for r in flat} <= set(range(1, 8))


def test_boxes():
    for value, text in [([1, 2, 3, 4], "1,2,3,4"), ("[1, 2, 3, 4]", "1,2,3,4"), ("1;2;3;4", "1,2,3,4"), ({"x1": 1.9, "y1": "2", "x2": 3, "y2": 4}, "1,2,3,4"), (None, ""), ([1, None, 2, 3], ""), ("1 2 3", ""), (5, "")]:
        assert shred.box_text(value) == text


def test_deep_and_empty(spark):
    tree = {"id": "x", "type": "section"}
    for i in range(200):
        tree = {"id": f"x{i}", "type": "section", "children": [tree]}
    df = spark.createDataFrame([("d", payload(tree), "clash")], "doc_id string, payload string, depth string")
    assert shred.found(df).count() == 200
    assert shred.found(df.limit(0)).collect() == []


def test_ten_thousand_nested_nodes():
    import json

    from sheafline.operators import shred

    n = 10_000
    text = '{"root": ' + "".join(f'{{"id": "n{i}", "type": "x", "children": [' for i in range(n)) + "]}" * n + "}"
    ids = [x[4] for x in shred.stripes_of(text) if x[4]]
    assert ids == [f"n{i}" for i in range(n)]
    assert shred.stripes_of(text[:-1]) == [] and shred.stripes_of(text + "]") == []
    for t in ('{"a": [1, -2.5e3, "x\\n\\u00e4", null, true, {}, [], {"b": [[]]}]}', ' [ ] ', '"s"', "7"):
        assert shred._loads_deep(t) == json.loads(t)
