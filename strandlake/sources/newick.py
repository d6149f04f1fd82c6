"""Newick trees and split registers as text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.sources.formats import c_general

SCHEMA = "tree_id long, idx int, parent_idx int, child_ordinal int, name string, length double, bootstrap double, probability double, is_root boolean, is_ghost boolean, hybrid_kind string, hybrid_id int, node_dict map<string,string>, edge_dict map<string,string>"
_TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s'\[\](),:;]+")
_NAME = re.compile(r"(.*?)#(H|LGT|R)(\d+)\Z", re.S)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if not m[0].isspace() and not (m[0][0] == "[" and m[0][1:2] not in "&"):
            out.append(m[0])
    return out


def _dict(token: str) -> dict[str, str]:
    body = token[2:-1]
    body = body[4:].replace(":", ",") if body.startswith("NHX:") else body
    return {k: v for k, _, v in (x.partition("=") for x in re.findall(r"[^,{]*(?:\{[^}]*\})?[^,]*", body) if x)}


def parse(text: str, rich: bool = True, negative: str = "error") -> list[list[dict]]:
    """Trees as lists of nodes in pre-order. negative: what a negative length does: error, zero or ok."""
    toks, out, i = _tokens(text), [], 0

    def values() -> dict:
        nonlocal i
        got: dict = {"length": None, "bootstrap": None, "probability": None, "edge_dict": {}}
        for key in ("length", "bootstrap", "probability"):
            if toks[i] != ":":
                break
            i += 1
            while toks[i][0] == "[":
                got["edge_dict"] |= _dict(toks[i]) if rich else {}
                i += 1
            if toks[i] not in ":,);":
                x = float(toks[i])
                if key == "length" and x < 0 and negative != "ok":
                    if negative == "error":
                        raise ValueError("negative branch")
                    x = 0.0
                if key != "length" and not 0 <= x <= 1:
                    raise ValueError(f"{key} outside 0 to 1")
                got[key] = x
                i += 1
        while toks[i][0] == "[":
            got["edge_dict"] |= _dict(toks[i]) if rich else {}
            i += 1
        return got

    while i < len(toks):
        rooted = True
        while toks[i][0] == "[":
            if toks[i].upper() in ("[&U]", "[&R]"):
                rooted = not (rich and toks[i].upper() == "[&U]")
            i += 1
        nodes: list[dict] = []
        stack: list[int] = []
        fresh = True
        while True:
            if fresh and toks[i] == "(":
                nodes.append({"idx": len(nodes), "parent_idx": stack[-1] if stack else -1, "node_dict": {}, "name": ""})
                stack.append(nodes[-1]["idx"])
                i += 1
                continue
            if fresh:
                nodes.append({"idx": len(nodes), "parent_idx": stack[-1] if stack else -1, "node_dict": {}, "name": ""})
                here = nodes[-1]
            # a label follows, for a leaf or for the node that was just closed
            if toks[i] not in "(),:;" and toks[i][0] != "[":
                t = toks[i]
                here["name"] = t[1:-1].replace("''", "'") if t[0] == "'" else t
                i += 1
            while toks[i][0] == "[":
                here["node_dict"] |= _dict(toks[i]) if rich else {}
                i += 1
            here |= values()
            if m := _NAME.match(here["name"]) if rich else None:
                here |= {"name": m[1], "hybrid_kind": m[2], "hybrid_id": int(m[3])}
            if toks[i] == ",":
                i += 1
                fresh = True
            elif toks[i] == ")":
                here = nodes[stack.pop()]
                i += 1
                fresh = False
            elif toks[i] == ";" and not stack:
                i += 1
                break
            else:
                raise ValueError(f"unexpected {toks[i]!r}")
        seen: set = set()
        inner = {n["parent_idx"] for n in nodes}
        for n in nodes:
            key = (n.get("hybrid_kind"), n.get("hybrid_id"))
            n["is_root"], n["is_ghost"] = n["parent_idx"] < 0 and rooted, key[0] is not None and n["idx"] not in inner and key in seen
            seen.add(key)
        count: dict = {}
        for n in nodes:
            n["child_ordinal"] = count.get(n["parent_idx"], 0)
            count[n["parent_idx"]] = n["child_ordinal"] + 1
        out.append(nodes)
    return out


_COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]


def read_trees(texts: DataFrame, column: str = "value", key: str = "tree_id", rich: bool = True, negative: str = "error") -> DataFrame:
    """Flat trees of a column of Newick texts, one or several trees a text; key numbers the texts."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column], strict=True):
                for t in parse(text, rich, negative):
                    rows += [[k, *(n.get(c) for c in _COLUMNS[1:])] for n in t]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"hybrid_id": "object"})

    return texts.select(key, column).mapInPandas(run, SCHEMA)


def quote(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if re.search(r"[\s'\[\](),:;]", name) else name


def write(tree) -> str:
    """(name, [(length, subtree)]) as Newick; lengths as %.10g. Names with special characters are quoted."""

    def one(node) -> str:
        name, children = node
        inner = "(" + ",".join(one(t) + (f":{c_general(x, 10)}" if x is not None else "") for x, t in children) + ")" if children else ""
        return inner + quote(name or "")

    return one(tree) + ";"


def write_flat(nodes: list[dict], rich: bool = True) -> str:
    """A flat tree as Newick; rich adds [&U] for unrooted trees, hybrids and dictionaries."""
    below: dict = {}
    for n in nodes:
        below.setdefault(n["parent_idx"], []).append(n)
    dict_ = lambda d: "[&" + ",".join(f"{k}={v}" for k, v in d.items()) + "]" if rich and d else ""

    def one(n: dict) -> str:
        inner = "(" + ",".join(map(one, below[n["idx"]])) + ")" if n["idx"] in below else ""
        name = quote(n["name"] or "") + (f"#{n['hybrid_kind']}{n['hybrid_id']}" if rich and n.get("hybrid_kind") else "")
        parts = [None if n.get(k) is None else c_general(n[k], 10) for k in ("length", "bootstrap", "probability")]
        while parts and parts[-1] is None:
            parts.pop()
        tail = "".join(":" + (p or "") for p in parts)
        edge = dict_(n.get("edge_dict") or {})
        return inner + name + dict_(n.get("node_dict") or {}) + (tail or (":" if edge else "")) + edge

    root = below[-1][0]
    return ("" if root["is_root"] or not rich else "[&U]") + one(root) + ";"


# ---- splits ---------------------------------------------------------------------------------------------------------

_BASES = {"0d": 10, "0b": 2, "0o": 8, "0x": 16}
_SPLIT = re.compile(r"\s*(?:(0[dbox])([0-9A-Fa-f]+)|\(([\d,\s]*)\))(?:#([-+0-9.eE]+))?")


def parse_splits(text: str) -> tuple[list[str], list[tuple[int, float]]]:
    """names, [(canonical mask, weight)] of `names... : split#weight ...;`."""
    head, colon, rest = re.match(r"((?:\s*(?:'(?:[^']|'')*'|\"[^\"]*\"|[^\s:;'\"]+))*)\s*(:?)(.*);\s*\Z", text, re.S).groups()
    names = [t[1:-1].replace("''", "'") if t[0] in "'\"" else t for t in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|[^\s'\"]+", head)]
    if len(set(names)) < len(names):
        raise ValueError("a name is there twice")
    out, at, full = [], 0, (1 << len(names)) - 1
    while rest[at:].strip():
        m = _SPLIT.match(rest, at)
        if not m:
            raise ValueError(f"not a split: {rest[at : at + 20]!r}")
        mask = int(m[2], _BASES[m[1]]) if m[1] else sum(1 << int(i) for i in m[3].split(",") if i.strip())
        if mask > full:
            raise ValueError("too many bits")
        out.append((min(mask, full - mask), float(m[4] or 1)))
        at = m.end()
    return names, out


def write_splits(names: list[str], splits: list[tuple[int, float]], digits: int = 15) -> str:
    """Names are quoted if they hold quotes, blanks or colons, or could be read as numbers."""
    q = lambda n: "'" + n.replace("'", "''") + "'" if re.search(r"[\s:;'\"]", n) or n.isdigit() else n
    return " ".join(map(q, names)) + ":" + "".join(f" 0d{m}#{c_general(w, digits)}" for m, w in splits) + ";"


def read_splits(texts: DataFrame, column: str = "value", key: str = "register_id") -> tuple[DataFrame, DataFrame]:
    """(names, splits) of a column of registers: (key, bit, name) and (key, mask in decimal, weight); equal splits are added."""

    def names(batches):
        for pdf in batches:
            rows = [(k, i, n) for k, t in zip(pdf[key], pdf[column], strict=True) for i, n in enumerate(parse_splits(t)[0])]
            yield pd.DataFrame(rows, columns=[key, "bit", "name"])

    def splits(batches):
        for pdf in batches:
            rows = [(k, str(m), w) for k, t in zip(pdf[key], pdf[column], strict=True) for m, w in parse_splits(t)[1]]
            yield pd.DataFrame(rows, columns=[key, "mask", "weight"])

    kind, own = texts.schema[key].dataType.simpleString(), texts.select(key, column)
    found = own.mapInPandas(splits, f"{key} {kind}, mask string, weight double")
    return own.mapInPandas(names, f"{key} {kind}, bit int, name string"), found.groupBy(key, "mask").agg(F.sum("weight").alias("weight"))


def splits_text(names: DataFrame, splits: DataFrame, digits: int = 15, key: str = "register_id") -> DataFrame:
    """key, value: each register as text, its splits by mask. A register's splits are one task's, as its text is one value."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            raise ValueError("splits without names")
        rows = sorted(((int(m), w) for m, w in zip(right["mask"], right["weight"], strict=True)))
        return pd.DataFrame({key: [left[key].iloc[0]], "value": [write_splits(left.sort_values("bit")["name"].tolist(), rows, digits)]})

    kind = names.schema[key].dataType.simpleString()
    return names.groupBy(key).cogroup(splits.groupBy(key)).applyInPandas(one, f"{key} {kind}, value string")


def newick_texts(nodes: DataFrame, rich: bool = True) -> DataFrame:
    """tree_id, value: flat trees (of one tree an id) as Newick; a tree is one task's, as its text is one value."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("idx").astype(object).where(pdf.sort_values("idx").notna(), None).to_dict("records")
        for r in rows:
            r |= {"is_root": r.get("is_root", True), **{k: dict(r.get(k) or {}) for k in ("node_dict", "edge_dict")}}
            if r.get("hybrid_id") is not None:
                r["hybrid_id"] = int(r["hybrid_id"])
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "value": [write_flat(rows, rich)]})

    return nodes.groupBy("tree_id").applyInPandas(one, "tree_id long, value string")
