"""Merging against a fold in arrival order."""

import random

import pytest

from weftgraph import model as M
from weftgraph.operators import merge

RANK = {"RESOLVED": 2, "SYNTACTIC": 1}
FILLED = {"fqn": ("", None), "file_path": ("", None), "line_start": (0, None), "line_end": (0, None), "module": ("", None), "layer": ("", "unknown", None), "source": ("", None)}


def fold(reports):
    kept = None
    for x in reports:
        x = dict(x, annotations=set(x["annotations"] or ()), props=dict(x["props"] or {}))
        if kept is None:
            kept = x
            continue
        new, old = (x, kept) if RANK.get((x["confidence"] or "").upper(), 0) > RANK.get((kept["confidence"] or "").upper(), 0) else (kept, x)
        out = dict(new)
        for c, gaps in FILLED.items():
            if out[c] in gaps:
                out[c] = old[c]
        out["annotations"] = new["annotations"] | old["annotations"]
        out["props"] = {**old["props"], **new["props"]}
        kept = out
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_is_a_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for pos in range(400):
        rows.append({
            "id": f"i{r.randrange(25)}", "kind": r.choice(["class", "method", None]), "label": f"l{pos}", "fqn": r.choice(["", None, f"f{pos}"]), "file_path": r.choice(["", f"p{pos}"]), "line_start": r.choice([0, None, pos]), "line_end": r.choice([None, pos]), "module": r.choice(["", f"m{pos}", None]),
            "layer": r.choice(["unknown", "backend", "", None]), "confidence": r.choice(["RESOLVED", "SYNTACTIC", "LEXICAL", "syntactic", None, "odd"]), "source": r.choice(["", f"s{pos}"]), "annotations": r.choice([None, [], ["b", "a"], [f"n{pos % 5}"]]), "props": r.choice([None, {}, {f"k{pos % 4}": str(pos), "z": str(pos)}, {f"k{pos % 3}": None}]),
        })
    want = {}
    for i in {x["id"] for x in rows}:
        x = fold([y for y in rows if y["id"] == i])
        layer = x["layer"] if x["layer"] not in ("", None) else "unknown"
        clean = lambda v: v or None
        want[i] = (x["kind"], x["label"], clean(x["fqn"]), clean(x["file_path"]), clean(x["line_start"]), clean(x["line_end"]), clean(x["module"]), layer, x["confidence"], clean(x["source"]), sorted(x["annotations"]), {k: v for k, v in x["props"].items()})
    names = [f.name for f in M.NODES]
    frame = spark.createDataFrame([(*(x[c] for c in names), p) for p, x in enumerate(rows)], "id string, kind string, label string, fqn string, file_path string, line_start long, line_end long, module string, layer string, confidence string, source string, annotations array<string>, props map<string,string>, pos long").repartition(5)
    out = merge.merge_nodes(frame, ["pos"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x["id"]: tuple(x)[1:] for x in out.collect()} == want


def test_merged_edges(spark):
    rows = [("a", "calls", "x", "y", "LEXICAL", "", {"k": "1"}, 1), ("b", "calls", "x", "y", "RESOLVED", "", {"k": "2", "m": "3"}, 2), ("c", "calls", "x", "y", "SYNTACTIC", "s", {"n": "4"}, 3), ("d", "imports", "x", "y", None, None, None, 4)]
    frame = spark.createDataFrame(rows, "id string, kind string, src string, dst string, confidence string, source string, props map<string,string>, pos long")
    got = {x["kind"]: (x["id"], x["confidence"], x["source"], x["props"]) for x in merge.merge_edges(frame, ["pos"]).collect()}
    assert got == {"calls": ("b", "RESOLVED", "s", {"k": "2", "m": "3", "n": "4"}), "imports": ("d", None, None, {})}
