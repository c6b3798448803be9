"""Deeply nested page documents into related flat tables, by structural variants.

A bottom-up tree automaton gives every JSON node a state from its kind and the states of its children: a list of two
numbers is a `pair`, a list of pairs and corners `points`, an object whose `page` is a page a `wrapped_page`, and so on.
States are worked out once per document, from the leaves up and without recursion, so a document may be nested to any
depth. The state of a part names its structural variant, and each variant is routed to the reader that knows its form. What
comes out are typed subtype tables (boxes, points, rows, candidates, other names), split by variant, that share the
supertype's keys (save_id, shape_idx, kind, item_path) and the path of the part they belong to.

Edge cases, all defined: null, empty, cut off or otherwise invalid documents don't count; a document that is
valid JSON but has no boxes counts as the latest save and gives no rows; a document may be the page, a list of
pages (their boxes are numbered through) or an object with the page under `page`; a part may be written as JSON text; null
boxes and null parts keep their position and give no row; coordinates, scores and heights that are no numbers are null; of
saves with the same saved_at the greater save_id counts; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

#: What a box states is kept once beside its parts and joins them only when they are told apart.
KEYS = "kind:string,item_path:string,variant:string"
CONTENT = "a:double,b:double,text:string,ref:string"
BOX = "struct<shape_idx:int,group_id:bigint,label:string,human:string,parts:array<struct<{}>>>"
#: The typed columns of each subtype, by what they are called in CONTENT.
SUBTYPES = {
    "shape": {},
    "point": {"x": "a", "y": "b"},
    "row": {"y0": "a", "y1": "b", "text": "text", "entity": "ref"},
    "candidate": {"score": "a", "entity": "text"},
    "other_name": {"name": "text", "lang": "ref"},
}
# Where a part may be written as JSON text.
ENCODED = frozenset(("shapes", "points", "row_struct", "rows", "authority", "candidates", "structured", "data", "other_names"))
BLANK = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
LITERALS = (("null", None), ("true", True), ("false", False), ("NaN", float("nan")), ("Infinity", float("inf")), ("-Infinity", float("-inf")))
MISSING = object()


# ---- JSON of any depth


def _value_at(s: str, i: int):
    """(scalar, where it ends) of the scalar at i."""
    if s[i : i + 1] == '"':
        return scanstring(s, i + 1, True)
    for word, v in LITERALS:
        if s.startswith(word, i):
            return v, i + len(word)
    m = NUMBER.match(s, i)
    if m is None:
        raise ValueError(f"no value at {i}")
    return (float(m.group()) if m.group(1) or m.group(2) else int(m.group())), m.end()


def _key_at(s: str, i: int) -> tuple[str, int]:
    if s[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(s, i + 1, True)
    i = BLANK.match(s, i).end()
    if s[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, BLANK.match(s, i + 1).end()


def loads(s: str):
    """What json.loads gives; a text that is nested too deep for it is read with a stack of its own."""
    try:
        return json.loads(s)
    except RecursionError:
        pass
    open_: list = []
    i = BLANK.match(s, 0).end()
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            node, key = ({} if c == "{" else []), None
            i = BLANK.match(s, i + 1).end()
            if s[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, i = _key_at(s, i)
                open_.append([node, key])
                continue
            value, i = node, i + 1
        else:
            value, i = _value_at(s, i)
        while True:
            i = BLANK.match(s, i).end()
            if not open_:
                if i != len(s):
                    raise ValueError(f"more behind the document at {i}")
                return value
            node, key = open_[-1]
            if isinstance(node, dict):
                node[key] = value
            else:
                node.append(value)
            c = s[i : i + 1]
            if c == ",":
                i = BLANK.match(s, i + 1).end()
                if isinstance(node, dict):
                    open_[-1][1], i = _key_at(s, i)
                break
            if c != ("}" if isinstance(node, dict) else "]"):
                raise ValueError(f"not closed at {i}")
            value, i = node, i + 1
            open_.pop()


def dumps(v) -> str:
    """What json.dumps gives, at any depth."""
    try:
        return json.dumps(v)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [(None, v)]
    while todo:
        said, node = todo.pop()
        if said is not None:
            out.append(said)
        elif isinstance(node, dict):
            out.append("{")
            todo.append(("}", None))
            for n, (k, x) in reversed(list(enumerate(node.items()))):
                todo += [(None, x), ((", " if n else "") + json.dumps(k) + ": ", None)]
        elif isinstance(node, list):
            out.append("[")
            todo.append(("]", None))
            for n, x in reversed(list(enumerate(node))):
                todo += [(None, x), *([(", ", None)] if n else [])]
        else:
            out.append(json.dumps(node))
    return "".join(out)


# ---- the automaton


def number(v) -> float | None:
    """The number a scalar states, as a number or in print."""
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        try:
            return float(v)
        except OverflowError:
            return float("inf") if v > 0 else float("-inf")
    if isinstance(v, str):
        try:
            return float(v.strip().replace(",", "."))
        except ValueError:
            return None
    return None


def leaf_state(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool) or isinstance(v, str) and number(v) is not None:
        return "number"
    return "word" if isinstance(v, str) else "scalar"


def list_state(below: set[str], n: int) -> str:
    if not below:
        return "empty_list"
    if below <= {"number"}:
        return "pair" if n == 2 else "flat_numbers"
    if below <= {"pair", "corner", "null", "flat_numbers", "empty_list"}:
        return "points"
    if below <= {"page", "wrapped_page", "null"} and below & {"page", "wrapped_page"}:
        return "pages"
    return "list"


def object_state(node: dict, child) -> str:
    """The state of an object; `child` gives the state of what stands under a key."""
    if "x" in node and "y" in node:
        return "corner"
    if "rows" in node:
        return "rows_in_object"
    if "shapes" in node:
        return "page"
    if child("page") == "page":
        return "wrapped_page"
    if child("xs") is not None and isinstance(node["xs"], list) and isinstance(node.get("ys"), list):
        return "columns"
    if "y0" in node or "ocr" in node or "authority" in node:
        return "row_resolved" if child("authority") not in (None, "null", "empty_object") else "row"
    if "name" in node:
        return "name_with_language" if "lang" in node else "name"
    if "id" in node:
        return "candidate_scored" if child("score") == "number" else "candidate"
    return "object" if node else "empty_object"


class Tree:
    """A document with the state of each of its nodes."""

    def __init__(self, doc) -> None:
        self.doc, self.said, self.known = doc, {}, {}
        order, todo = [], [doc]
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                order.append(node)
                for k, v in node.items():
                    if k in ENCODED and isinstance(v, str) and v.strip()[:1] in ("[", "{"):
                        try:
                            v = self.said[id(node), k] = loads(v)
                        except ValueError:
                            continue
                    if isinstance(v, (dict, list)):
                        todo.append(v)
            elif isinstance(node, list):
                order.append(node)
                todo += [v for v in node if isinstance(v, (dict, list))]
        # Children stand behind their parents in this order, so from its end every child is known before its parent.
        for node in reversed(order):
            if isinstance(node, list):
                self.known[id(node)] = list_state({self.state(v) for v in node}, len(node))
            else:
                self.known[id(node)] = object_state(node, lambda k, node=node: self.state(self.get(node, k)) if k in node else None)

    def state(self, v) -> str:
        return self.known[id(v)] if isinstance(v, (dict, list)) else leaf_state(v)

    def get(self, node, key: str):
        """What stands under a key of an object, read where it is JSON text; None where there is no such object or key."""
        return self.said.get((id(node), key), node.get(key)) if isinstance(node, dict) else None


# ---- the readers of each variant: they give (place, variant, a, b, text, ref)


def _xy(p) -> tuple[float | None, float | None]:
    if isinstance(p, dict):
        return number(p.get("x")), number(p.get("y"))
    return (number(p[0]) if p else None), (number(p[1]) if len(p) > 1 else None)


def _flat(form: str):
    return lambda t, v: ((k, form, number(v[2 * k]), number(v[2 * k + 1]), None, None) for k in range(len(v) // 2))


def _listed(t: Tree, v) -> Iterator[tuple]:
    for k, p in enumerate(v):
        s = t.state(p)
        if s in ("pair", "corner", "flat_numbers"):
            yield k, "pair" if s == "flat_numbers" else s, *_xy(p), None, None


def _columns(t: Tree, v) -> Iterator[tuple]:
    yield from ((k, "columns", number(x), number(y), None, None) for k, (x, y) in enumerate(zip(v["xs"], v["ys"])))


POINTS = {"corner": lambda t, v: iter([(0, "corner", *_xy(v), None, None)]), "pair": _flat("pair_alone"), "flat_numbers": _flat("flat"), "points": _listed, "pages": _listed, "list": _listed, "columns": _columns}


def _text(v) -> str | None:
    return v if isinstance(v, str) else None if v is None else dumps(v)


def _row(t: Tree, k: int, v, form: str) -> tuple:
    if not isinstance(v, dict):
        return k, form, None, None, _text(v), None
    layers = [v.get(c) for c in ("human", "llm", "ocr")]
    authority = t.get(v, "authority")
    return k, form, number(v.get("y0")), number(v.get("y1")), next((x for x in layers if isinstance(x, str) and x.strip()), None), _text(authority.get("id")) if isinstance(authority, dict) else None


def _members(v, alone: bool = False) -> list[tuple[int, object]]:
    """The entries of a list with their places; a single object or, where `alone`, a string counts as one."""
    if isinstance(v, list):
        return [(k, x) for k, x in enumerate(v) if x is not None]
    return [(0, v)] if isinstance(v, dict) and v or alone and isinstance(v, str) and v.strip() else []


def _rows(t: Tree, v) -> Iterator[tuple[tuple, object]]:
    s = t.state(v)
    if s == "rows_in_object":
        yield from ((_row(t, k, x, "in_object"), x) for k, x in _members(t.get(v, "rows")))
    elif s in ("row", "row_resolved") or isinstance(v, dict) and ("y0" in v or "ocr" in v or "authority" in v):
        yield _row(t, 0, v, "alone"), v
    elif isinstance(v, list):
        yield from ((_row(t, k, x, "bare_list"), x) for k, x in _members(v))


def _candidate(t: Tree, v) -> tuple:
    if not isinstance(v, dict):
        return t.state(v), None, None, _text(v), None
    return t.state(v), number(v.get("score")), None, _text(v.get("id")), None


def _name(t: Tree, v) -> tuple:
    if not isinstance(v, dict):
        return t.state(v), None, None, _text(v), None
    return t.state(v), None, None, _text(v.get("name")), _text(v.get("lang"))


def whole(v) -> int:
    """The whole number a group_id states, -1 if it states none."""
    if isinstance(v, bool) or v is None:
        return -1
    if isinstance(v, (int, float)):
        return int(v) if v == v and abs(v) < 2**63 and v == int(v) else -1
    if isinstance(v, str):
        try:
            return whole(int(v.strip()))
        except ValueError:
            try:
                return whole(float(v.strip()))
            except (ValueError, OverflowError):
                return -1
    return -1


def boxes(t: Tree) -> list:
    """The boxes of all pages of a document, in its order."""
    out, todo = [], [t.doc]
    while todo:
        node = todo.pop()
        s = t.state(node)
        if s == "pages":
            todo += [p for p in reversed(node) if p is not None]
            continue
        shapes = t.get(t.get(node, "page") if s == "wrapped_page" else node, "shapes")
        out += shapes if isinstance(shapes, list) else []
    return out


def parts_of(t: Tree, b: dict) -> Iterator[tuple]:
    """(kind, item_path, variant, a, b, text, ref) of a box and its parts in document order."""
    points = t.get(b, "points")
    s = t.state(points)
    yield "shape", "", s, None, None, None, None
    for k, *rest in POINTS[s](t, points) if s in POINTS else ():
        yield "point", str(k), *rest
    for (r, *rest), row in _rows(t, t.get(b, "row_struct")):
        yield "row", str(r), *rest
        for c, cand in _members(t.get(t.get(row, "authority"), "candidates")):
            yield "candidate", f"{r}.{c}", *_candidate(t, cand)
    for k, name in _members(t.get(t.get(t.get(b, "structured"), "data"), "other_names"), alone=True):
        yield "other_name", str(k), *_name(t, name)


def typed_boxes(text: str | None, content: bool = True) -> list[dict] | None:
    """The boxes of one document with their typed parts in document order, None if it isn't valid JSON."""
    if text is None or not text.strip():
        return None
    try:
        t = Tree(loads(text))
    except ValueError:
        return None
    names = [f.split(":")[0] for f in (f"{KEYS},{CONTENT}" if content else KEYS).split(",")]
    out: list[dict] = []
    for i, b in enumerate(boxes(t)):
        if not isinstance(b, dict):
            continue
        label, human = b.get("label"), b.get("human_output")
        human = human.get("human_corrected_text") if isinstance(human, dict) else human
        own = [dict(zip(names, p)) for p in parts_of(t, b)]
        out.append({"shape_idx": i, "group_id": whole(b.get("group_id")), "label": "" if label is None else _text(label), "human": human if isinstance(human, str) else None, "parts": own})
    return out


# ---- the tables


def shred(page_docs: DataFrame, content: bool = False) -> DataFrame:
    """(save_id, project, stem, shape_idx, kind, item_path, variant, group_id, label, human) of the saves that count, with `content` a, b, text and ref too.

    A document is read once, where it lies; only its parts are shuffled, and of each page only the save that wins
    so far leaves a task, so that a page saved very often doesn't gather in one place.
    """
    schema = f"save_id bigint, project string, stem string, saved_at timestamp, boxes array<{BOX.format(f'{KEYS},{CONTENT}' if content else KEYS)}>"

    def read(batches):
        import pandas as pd

        for b in batches:
            found = [typed_boxes(t, content) for t in b["doc"]]
            keep = [p is not None for p in found]
            rest = b.loc[keep, ["save_id", "project", "stem", "saved_at"]].reset_index(drop=True)
            rest["boxes"] = pd.Series([p for p in found if p is not None], dtype=object)
            yield rest

    saves = page_docs.select("save_id", "project", "stem", "saved_at", "doc").mapInPandas(read, schema)
    winner = F.max_by(F.struct("save_id", "boxes"), F.struct("saved_at", "save_id"))
    last = saves.groupBy("project", "stem").agg(winner.alias("w")).select("project", "stem", "w.save_id", F.explode("w.boxes").alias("b"))
    each = last.select("save_id", "project", "stem", "b.shape_idx", "b.group_id", "b.label", "b.human", F.explode("b.parts").alias("p"))
    return each.select("save_id", "project", "stem", "shape_idx", "p.kind", "p.item_path", "p.variant", "group_id", "label", "human", *(["p.a", "p.b", "p.text", "p.ref"] if content else []))


def flat_parts(page_docs: DataFrame) -> DataFrame:
    """(save_id, shape_idx, kind, item_path, group_id, label): every part with the box and page it belongs to."""
    return shred(page_docs).select("save_id", "shape_idx", "kind", "item_path", "group_id", "label")


def subtype(parts: DataFrame, kind: str, variant: str | None = None) -> DataFrame:
    """The table of one kind of part, or of one structural variant of it: the supertype's keys, the path of the part above, and the typed columns of the kind."""
    t = parts.where(F.col("kind") == kind)
    t = t if variant is None else t.where(F.col("variant") == variant)
    parent = F.when(F.col("kind") == "candidate", F.substring_index("item_path", ".", 1)).when(F.col("kind") != "shape", "").alias("parent_path")
    own = ["group_id", "label", "human"] if kind == "shape" else [F.col(c).alias(n) for n, c in SUBTYPES[kind].items()]
    return t.select("save_id", "project", "stem", "shape_idx", "item_path", parent, "variant", *own)


def subtype_tables(page_docs: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """A typed table for each kind and structural variant that the documents hold; parts are read once and routed from there."""
    every = cut(shred(page_docs, content=True))
    # The automaton has a fixed number of states.
    held = every.select("kind", "variant").distinct().collect()
    return {(r.kind, r.variant): subtype(every, r.kind, r.variant) for r in sorted(held)}
