"""Reading order and joining of text runs.

A page's runs form one array and are folded by higher-order functions, so a page is one
row and nothing is shuffled but the grouping by page. Columns of a run: seq, text, left,
bottom, right, top, font_size, space_after, rtl, vertical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["seq", "text", "left", "bottom", "right", "top", "font_size", "space_after", "rtl", "vertical"]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def median_size(runs: Column) -> Column:
    """The upper median of font sizes."""
    return let(F.array_sort(F.transform(runs, lambda r: r["font_size"])), lambda sizes: F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))


def by_seq(runs: Column) -> Column:
    """Runs in the order of the content."""
    return F.array_sort(runs, lambda a, b: a["seq"] - b["seq"])


def _sorted(runs: Column, *keys) -> Column:
    """Runs by keys, each a function of a run and 1 or -1 for falling; equal ones stay in their order."""
    numbered = F.transform(runs, lambda r, i: F.struct(r.alias("run"), i.alias("nth")))

    def compare(a: Column, b: Column) -> Column:
        out = a["nth"] - b["nth"]
        for key, sign in reversed(keys):
            out = F.when(key(a["run"]) < key(b["run"]), -sign).when(key(a["run"]) > key(b["run"]), sign).otherwise(out)
        return out

    return F.transform(F.array_sort(numbered, compare), lambda x: x["run"])


def _reach(runs: Column) -> Column:
    """How far apart the bottoms of runs of a line may be at most, whatever their sizes."""
    return F.greatest(F.lit(1.5), 0.35 * F.array_max(F.transform(runs, lambda r: r["font_size"])))


def _falling(runs: Column) -> Column:
    return _sorted(runs, (lambda r: r["bottom"], -1))


def _apart(falling: Column, reach: Column) -> Column:
    """Whether each run is further below the one before than a line reaches, and so is a line by itself."""
    rest = F.greatest(F.size(falling) - 1, F.lit(0))
    near = F.zip_with(F.slice(falling, F.lit(1), rest), F.slice(falling, F.lit(2), rest), lambda a, b: F.coalesce(a["bottom"] - b["bottom"] <= reach, F.lit(True)))
    return ~F.exists(near, lambda x: x)


def lines_of(runs: Column) -> Column:
    """Runs by falling bottom, equal ones in their order, put greedily into the first line whose first run is near enough: an array of lines, each an array of runs."""
    return let(_reach(runs), lambda reach: let(_falling(runs), lambda o: _greedy(o, reach)))


def _greedy(ordered: Column, reach: Column) -> Column:
    """Lines of runs by falling bottom. A line whose first run is further up than any run may be takes no more: it is closed, and only open ones are looked at."""
    none = F.array(F.filter(ordered, lambda x: F.lit(False)))
    start = F.struct(F.slice(none, 1, 0).alias("closed"), F.slice(none, 1, 0).alias("open"))

    def place(held: Column, run: Column) -> Column:
        far = lambda line: F.coalesce(line[0]["bottom"] - run["bottom"] > reach, F.lit(False))
        near = lambda line: F.abs(line[0]["bottom"] - run["bottom"]) <= F.greatest(F.lit(1.5), 0.35 * F.greatest(line[0]["font_size"], run["font_size"]))
        own = F.array(F.array(run))

        def put(kept: Column) -> Column:
            at = F.array_position(F.transform(kept, near), True)
            return F.when(F.size(kept) == 0, own).otherwise(let(at, lambda at: F.when(at == 0, F.concat(kept, own)).otherwise(F.transform(kept, lambda line, i: F.when(i == at - 1, F.concat(line, F.array(run))).otherwise(line)))))

        shut = F.size(held["open"]) > 0
        return F.when(shut & far(held["open"][0]), F.struct(F.concat(held["closed"], F.filter(held["open"], far)).alias("closed"), let(F.filter(held["open"], lambda x: ~far(x)), put).alias("open"))).otherwise(F.struct(held["closed"].alias("closed"), put(held["open"]).alias("open")))

    return F.aggregate(ordered, start, place, lambda held: F.concat(held["closed"], held["open"]))


def line_order(line: Column) -> Column:
    """A line's runs from the left, or from the right where most are right-to-left; equal ones stay in their order, by falling bottom."""
    backward = F.size(F.filter(line, lambda r: r["rtl"])) > F.floor(F.size(line) / 2)
    return F.when(F.size(line) < 2, line).when(backward, _sorted(line, (lambda r: r["right"], -1))).otherwise(_sorted(line, (lambda r: r["left"], 1)))


def physical_order(runs: Column) -> Column:
    """Horizontal runs line by line, then vertical ones from the right and from the top."""

    def by_lines(level: Column) -> Column:
        ordered = lambda o, reach: F.when(_apart(o, reach), o).otherwise(F.flatten(F.transform(_greedy(o, reach), line_order)))
        return let(_reach(level), lambda reach: let(_falling(level), lambda o: ordered(o, reach)))

    upright = _sorted(F.filter(runs, lambda r: r["vertical"]), (lambda r: r["right"], -1), (lambda r: r["top"], -1))
    some = F.exists(runs, lambda r: r["vertical"])
    return F.when(some, F.concat(let(F.filter(runs, lambda r: ~r["vertical"]), by_lines), upright)).otherwise(by_lines(runs))


def _centre(run: Column) -> Column:
    return (run["left"] + run["right"]) / 2


def _several_rows(side: Column) -> Column:
    """Whether a run's bottom is away from the first one's by over 2 and over half the larger size."""
    return F.exists(side, lambda r: F.abs(r["bottom"] - side[0]["bottom"]) > F.greatest(F.lit(2.0), 0.5 * F.greatest(r["font_size"], side[0]["font_size"])))


def column_split(ordered: Column) -> Column:
    """How many of the runs, ordered by centre, are in the left of two columns: up to the widest of the gaps between centres that are over 4 median sizes and have several rows at both sides, the first of equal ones; null without one."""
    n = F.size(ordered)
    gap = lambda i: _centre(F.get(ordered, i)) - _centre(F.get(ordered, i - 1))

    def widest(median: Column) -> Column:
        wide = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(gap(i) > 4 * median, F.lit(False)))
        fit = F.filter(wide, lambda i: _several_rows(F.slice(ordered, F.lit(1), i)) & _several_rows(F.slice(ordered, i + 1, n - i)))
        return -F.array_max(F.transform(fit, lambda i: F.struct(gap(i).alias("gap"), (-i).alias("at"))))["at"]

    return let(median_size(ordered), widest)


def reading_order(runs: Column) -> Column:
    """Physical order within each of two columns, if there are two; of pages with under four runs or with vertical ones, physical order."""

    def parted(ordered: Column) -> Column:
        halves = lambda at: F.when(at.isNull(), physical_order(runs)).otherwise(F.concat(physical_order(F.slice(ordered, F.lit(1), at)), physical_order(F.slice(ordered, at + 1, F.size(ordered)))))
        return let(column_split(ordered), halves)

    plain = (F.size(runs) < 4) | F.exists(runs, lambda r: r["vertical"])
    return F.when(plain, physical_order(runs)).otherwise(let(_sorted(runs, (_centre, 1)), parted))


def _trimmed(text: Column) -> Column:
    """Without white space at either end."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"\p{IsWhite_Space}")
    return let(text, lambda t: F.when(ends(t), F.regexp_replace(t, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")).otherwise(t))


def joined(runs: Column) -> Column:
    """Texts of ordered runs with a line feed, a space or nothing between neighbours, trimmed."""
    before = lambda i: F.get(runs, i - 1)

    def separator(r: Column, i: Column) -> Column:
        return let(before(i), lambda p: between(r, p, i))

    def between(r: Column, p: Column, i: Column) -> Column:
        moved = F.when(r["vertical"], F.abs(r["right"] - p["right"])).otherwise(F.abs(r["bottom"] - p["bottom"]))
        new_line = (r["vertical"] != p["vertical"]) | (moved > F.greatest(F.lit(2.0), 0.6 * F.greatest(r["font_size"], p["font_size"])))
        gap = F.when(r["vertical"], p["bottom"] - r["top"]).when(r["rtl"], p["left"] - r["right"]).otherwise(r["left"] - p["right"])
        space = p["space_after"] | (gap > F.greatest(F.lit(1.0), 0.15 * F.least(r["font_size"], p["font_size"])))
        return F.when(i == 0, "").when(new_line, "\n").when(space, " ").otherwise("")

    return _trimmed(F.array_join(F.transform(runs, lambda r, i: F.concat(separator(r, i), F.rtrim(r["text"]))), ""))


def raw_text(runs: Column) -> Column:
    """Texts in the order of the content, a space only where a run says so."""
    return _trimmed(F.array_join(F.transform(by_seq(runs), lambda r: F.concat(F.rtrim(r["text"]), F.when(r["space_after"], " ").otherwise(""))), ""))


def ordered(runs: Column, layout: str) -> Column:
    """A page's runs in the order of the layout: raw, physical or reading."""
    return let(by_seq(runs), {"raw": lambda x: x, "physical": physical_order, "reading": reading_order}[layout])


def nested_text(runs: Column, layout: str = "physical") -> Column:
    """Text of a page that has its runs in one array, as `page_text` gives it; empty without runs."""
    return F.when(F.size(runs) == 0, "").otherwise(let(ordered(runs, layout), raw_text if layout == "raw" else joined))


def page_text(runs: DataFrame, by: list[str], layout: str = "physical", area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """by and text of each page; layout is raw, physical or reading. Runs are ordered before those outside the area (left, bottom, right, top) go."""
    pages = runs.groupBy(*by).agg(F.collect_list(F.struct(*RUN)).alias("runs"))
    pages = pages.select(*by, ordered(F.col("runs"), layout).alias("runs"))
    if area:
        low_x, low_y, high_x, high_y = area
        pages = pages.select(*by, F.filter("runs", lambda r: (r["left"] <= high_x) & (r["right"] >= low_x) & (r["bottom"] <= high_y) & (r["top"] >= low_y)).alias("runs"))
    return pages.select(*by, (raw_text if layout == "raw" else joined)(F.col("runs")).alias("text"))


def search(runs: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """Runs that contain the needle, each by itself; a blank needle is refused. Case is ignored for letters that lower() maps one to one."""
    if not needle.strip():
        raise ValueError("the needle is blank")
    text = F.lower("text") if ignore_case else F.col("text")
    return runs.where(text.contains(needle.lower() if ignore_case else needle))
