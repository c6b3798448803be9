"""Lattices of cells on a page: scans whose steps depend on each other and stay within one page.

Every operator here runs page by page in sorted partitions; a page has about a hundred boxes. Input order
is (y1, x1, idx), so results don't depend on how rows arrive. Boxes with a null edge are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import by_group

BAND, NEAR, SHARE = 10.0, 600.0, 0.5


def per_page(df: DataFrame, page: list[str], work: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """`work` applied to the boxes of each page as a list of dicts; `schema` names what it gives besides the page's keys."""
    good = df.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    return by_group(good, page, ["y1", "x1", "idx"], work, schema)


def _groups(spans: list[tuple[float, float]]) -> list[int]:
    """The group of each span: the one whose median span it shares most of, half of the shorter at least; groups are numbered from 1 by where they begin."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], i))
    los, his, member = [], [], [0] * len(spans)
    for i in order:
        lo, hi = spans[i]
        best, most = -1, SHARE
        for g in range(len(los)):
            a, b = median(los[g]), median(his[g])
            part = max(0.0, min(hi, b) - max(lo, a)) / max(1.0, min(hi - lo, b - a))
            if part >= most:
                best, most = g, part
        if best < 0:
            los.append([])
            his.append([])
            best = len(los) - 1
        los[best].append(lo)
        his[best].append(hi)
        member[i] = best
    rank = {g: k + 1 for k, g in enumerate(sorted(range(len(los)), key=lambda g: (median(los[g]), g)))}
    return [rank[g] for g in member]


def coordinates(df: DataFrame, page: list[str]) -> DataFrame:
    """(page..., idx, super_row, super_column): rows and columns by overlapping intervals."""

    def work(boxes: list[dict]) -> list[dict]:
        rows, cols = _groups([(b["y1"], b["y2"]) for b in boxes]), _groups([(b["x1"], b["x2"]) for b in boxes])
        return [{"idx": b["idx"], "super_row": r, "super_column": c} for b, r, c in zip(boxes, rows, cols)]

    return per_page(df, page, work, "idx int, super_row int, super_column int")


def regions(df: DataFrame, page: list[str], near: float = NEAR) -> DataFrame:
    """(page..., idx, region): boxes whose centres come within reach of each other, then regions one above the other that share half their width made one."""

    def work(boxes: list[dict]) -> list[dict]:
        mid = [((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2) for b in boxes]
        label, n = [-1] * len(boxes), 0
        for s in range(len(boxes)):
            if label[s] >= 0:
                continue
            stack = [s]
            label[s] = n
            while stack:
                i = stack.pop()
                for j in range(len(boxes)):
                    if label[j] < 0 and (mid[i][0] - mid[j][0]) ** 2 + (mid[i][1] - mid[j][1]) ** 2 <= near * near:
                        label[j] = n
                        stack.append(j)
            n += 1
        spans = []
        for r in range(n):
            own = [b for b, g in zip(boxes, label) if g == r]
            spans.append([min(b["x1"] for b in own), max(b["x2"] for b in own), (min(b["y1"] for b in own) + max(b["y2"] for b in own)) / 2, r])
        spans.sort(key=lambda s: s[2])
        home, k, cur = {}, 0, None
        for lo, hi, _, r in spans:
            if cur and min(hi, cur[1]) - max(lo, cur[0]) >= max(1e-9, ((hi - lo) + (cur[1] - cur[0])) / 4):
                cur = [min(lo, cur[0]), max(hi, cur[1])]
            else:
                k += 1
                cur = [lo, hi]
            home[r] = k
        return [{"idx": b["idx"], "region": home[g]} for b, g in zip(boxes, label)]

    return per_page(df, page, work, "idx int, region int")


def completed(df: DataFrame, page: list[str], label: str = "label") -> DataFrame:
    """(page..., idx, super_row, super_column, box, label, added): the lattice with a cell in every slot that no other cell covers by half; new cells take the label of their row's nearest cell to the left, else the right."""

    def work(boxes: list[dict]) -> list[dict]:
        out = [b | {"added": False} for b in boxes if b["super_row"] is not None and b["super_column"] is not None]
        if not out:
            return []
        rows = {r: (median([b["y1"] for b in out if b["super_row"] == r]), median([b["y2"] for b in out if b["super_row"] == r])) for r in {b["super_row"] for b in out}}
        cols = {c: (median([b["x1"] for b in out if b["super_column"] == c]), median([b["x2"] for b in out if b["super_column"] == c])) for c in {b["super_column"] for b in out}}
        have = {(b["super_row"], b["super_column"]) for b in out}
        top = max(b["idx"] for b in boxes)
        for r in sorted(rows):
            for c in sorted(cols):
                if (r, c) in have:
                    continue
                (y1, y2), (x1, x2) = rows[r], cols[c]
                size = (x2 - x1) * (y2 - y1)
                if size <= 0 or any(max(0, min(x2, b["x2"]) - max(x1, b["x1"])) * max(0, min(y2, b["y2"]) - max(y1, b["y1"])) > 0.5 * size for b in out):
                    continue
                same = [b for b in out if b["super_row"] == r and not b["added"]]
                near = sorted(same, key=lambda b: (b["super_column"] > c, abs(b["super_column"] - c)))
                top += 1
                out.append({"idx": top, "super_row": r, "super_column": c, "x1": x1, "y1": y1, "x2": x2, "y2": y2, label: near[0][label] if near else None, "added": True})
        return out

    return per_page(df, page, work, f"idx int, super_row int, super_column int, x1 double, y1 double, x2 double, y2 double, {label} string, added boolean")


def trimmed(df: DataFrame, page: list[str]) -> DataFrame:
    """(page..., idx, box): overlapping boxes cut back to the middle of what they share, pair by pair in input order, along the side where they share less."""

    def work(boxes: list[dict]) -> list[dict]:
        bs = sorted((dict(b) for b in boxes), key=lambda b: b["idx"])
        for i, a in enumerate(bs):
            for b in bs[i + 1 :]:
                if any(k["x2"] <= k["x1"] or k["y2"] <= k["y1"] for k in (a, b)):
                    continue
                x1, y1, x2, y2 = max(a["x1"], b["x1"]), max(a["y1"], b["y1"]), min(a["x2"], b["x2"]), min(a["y2"], b["y2"])
                if x1 >= x2 or y1 >= y2:
                    continue
                lo, hi = ("x1", "x2") if x2 - x1 <= y2 - y1 else ("y1", "y2")
                cut = float(int(((x1 + x2) if lo == "x1" else (y1 + y2)) / 2 + 0.5))
                first, second = (a, b) if a[lo] <= b[lo] else (b, a)
                first[hi], second[lo] = min(first[hi], cut), max(second[lo], cut)
        return bs

    return per_page(df, page, work, "idx int, x1 double, y1 double, x2 double, y2 double")


def merged_same_label(df: DataFrame, page: list[str]) -> DataFrame:
    """(page..., idx, label, score, box, merged): free boxes of one label that overlap become one, again and again until none do; the better score and its index stay."""

    def work(boxes: list[dict]) -> list[dict]:
        bs = [dict(b) | {"merged": False} for b in sorted(boxes, key=lambda b: b["idx"])]
        i = 0
        while i < len(bs):
            hit = next((j for j in range(i + 1, len(bs)) if bs[j]["label"] == bs[i]["label"] and min(bs[i]["x2"], bs[j]["x2"]) > max(bs[i]["x1"], bs[j]["x1"]) and min(bs[i]["y2"], bs[j]["y2"]) > max(bs[i]["y1"], bs[j]["y1"])), None)
            if hit is None:
                i += 1
                continue
            a, b = bs[i], bs[hit]
            later = b["score"] is not None and (a["score"] is None or b["score"] > a["score"])
            k, d = (b, a) if later else (a, b)
            scores = [s for s in (a["score"], b["score"]) if s is not None]
            k |= {"x1": min(a["x1"], b["x1"]), "y1": min(a["y1"], b["y1"]), "x2": max(a["x2"], b["x2"]), "y2": max(a["y2"], b["y2"]), "score": max(scores) if scores else None, "merged": True}
            bs.remove(d)
            i = 0
        return bs

    return per_page(df, page, work, "idx int, label string, score double, x1 double, y1 double, x2 double, y2 double, merged boolean")


def cells_of(df: DataFrame, page: list[str], band: float = BAND) -> DataFrame:
    """(page..., idx, row_idx, col_idx): cells in rows and columns. A cell joins the first row whose mean band holds its middle; columns are runs of
    centres closer than 0.45 of the median width; of two cells in one slot the taller stays and the other moves up a row where that is free."""

    def work(boxes: list[dict]) -> list[dict]:
        if not boxes:
            return []
        groups: list[list[dict]] = []
        for b in boxes:
            cy = (b["y1"] + b["y2"]) / 2
            home = next((g for g in groups if sum(x["y1"] for x in g) / len(g) - band <= cy <= sum(x["y2"] for x in g) / len(g) + band), None)
            groups.append([b]) if home is None else home.append(b)
        widths = sorted(max(1.0, b["x2"] - b["x1"]) for b in boxes)
        reach = max(3.0, 0.45 * widths[len(widths) // 2])
        xs = sorted({(b["x1"] + b["x2"]) / 2 for b in boxes})
        runs = [[xs[0]]]
        for x in xs[1:]:
            runs[-1].append(x) if x - runs[-1][-1] <= reach else runs.append([x])
        centres = [sum(r) / len(r) for r in runs]
        slots: dict[tuple[int, int], dict] = {}
        for r, g in enumerate(groups):
            for b in sorted(g, key=lambda b: ((b["x1"] + b["x2"]) / 2, b["idx"])):
                cx = (b["x1"] + b["x2"]) / 2
                c = min(range(len(centres)), key=lambda i: abs(centres[i] - cx))
                loser, key = None, (r, c)
                if key in slots:
                    taller = max(1, b["y2"] - b["y1"]) > max(1, slots[key]["y2"] - slots[key]["y1"])
                    loser = slots[key] if taller else b
                    if taller:
                        slots[key] = b
                    if loser is not None and (r - 1, c) not in slots:
                        slots[(r - 1, c)] = loser
                else:
                    slots[key] = b
        low = min(0, min(r for r, _ in slots))
        return [{"idx": b["idx"], "row_idx": r - low, "col_idx": c} for (r, c), b in sorted(slots.items())]

    return per_page(df, page, work, "idx int, row_idx int, col_idx int")


def start_row(cells: DataFrame, page: list[str]) -> DataFrame:
    """(page..., start_row): the first row that has 0.6 of the columns of the fullest row, two at least; else the first row."""
    rows = cells.groupBy(*page, "row_idx").agg(F.countDistinct("col_idx").alias("n"))
    most = rows.groupBy(*page).agg(F.max("n").alias("most"), F.min("row_idx").alias("first"))
    full = rows.join(most, page).where(F.col("n") >= F.greatest(F.lit(2.0), F.col("most") * 0.6)).groupBy(*page).agg(F.min("row_idx").alias("start"))
    return most.join(full, page, "left").select(*page, F.coalesce("start", "first").alias("start_row"))


def page_height(cells: DataFrame, page: list[str], lines: str) -> DataFrame:
    """(page..., height): the sum over rows of the most lines a cell of the row has."""
    return cells.groupBy(*page, "row_idx").agg(F.max(lines).alias("n")).groupBy(*page).agg(F.sum("n").alias("height"))


def flow(df: DataFrame, page: list[str], title: str = "title", wide: float = 0.7) -> DataFrame:
    """(page..., idx, band, column, flow_order, article): the boxes of a newspaper page in the order of reading; an article begins at each title.

    Columns come from the groups of x-intervals of the boxes that are not wide; wide boxes cut the page into bands.
    """

    def work(boxes: list[dict]) -> list[dict]:
        if not boxes:
            return []
        width = max(b["x2"] for b in boxes) - min(b["x1"] for b in boxes) or 1.0
        is_wide = [(b["x2"] - b["x1"]) > wide * width for b in boxes]
        narrow = [i for i, w in enumerate(is_wide) if not w]
        groups = dict(zip(narrow, _groups([(boxes[i]["x1"], boxes[i]["x2"]) for i in narrow])))
        band, out = 0, []
        for i, b in enumerate(boxes):
            band += is_wide[i]
            out.append((2 * band - 1 if is_wide[i] else 2 * band, groups.get(i, 0), b))
            band += 0
        out.sort(key=lambda t: (t[0], t[1], t[2]["y1"], t[2]["x1"], t[2]["idx"]))
        article, rows = 0, []
        for k, (bd, col, b) in enumerate(out, 1):
            article += b.get("label") == title
            rows.append({"idx": b["idx"], "band": bd, "column": col, "flow_order": k, "article": article})
        return rows

    return per_page(df, page, work, "idx int, band int, column int, flow_order int, article int")
