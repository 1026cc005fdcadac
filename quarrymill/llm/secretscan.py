"""Secret scans: fixed patterns, and sliding-window Shannon entropy over other candidate strings.

A candidate is a run of characters that keys are made of. By its characters it belongs to a
class (hexadecimal, letters and digits, base64) with an entropy bound of its own. A window
slides over it: on each step the counts of the character that leaves and of the one that
enters change by one, so the entropy changes by four terms. Terms are whole millionths of
n log2 n, so the same windows pass everywhere. Runs on the allow-list are left alone.
All on DataFrame functions; rows are independent and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, whole

# The patterns that the contract names.
KEYWORD = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Class, pattern of the whole run, bits per character that a window must reach.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.6), ("base64", "^[A-Za-z0-9+/=_-]+$", 3.6)]
#: Runs that are no secrets: words, numbers, words joined by separators, published examples, alphabets.
ALLOWED = ["^[A-Za-z]+$", "^[0-9]+$", "^[A-Za-z]*[0-9]{0,4}([-_/=+]+[A-Za-z]*[0-9]{0,4})*$", "EXAMPLE", "0123456789", "(?i)abcdefghijkl"]

MARK, INNER, INSTEAD = "\u0001", "\u0002", "\u0003"


def term(n: int) -> int:
    """n log2 n in millionths."""
    return round(n * math.log2(n) * 1_000_000) if n else 0


def ceiling(bits: float, window: int = WINDOW) -> int:
    """The largest sum of terms at which a window still has ``bits`` of entropy: log2 w - sum / w."""
    return math.floor(window * (math.log2(window) - bits) * 1_000_000)


#: Pieces that are walked together; their matches are gathered by appending, so the work grows by this and not by a text's matches.
TOGETHER = 256


def found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches, leftmost and not overlapping: (start, end, group's length, text), in code points.

    Matches are fenced by a control character that was taken out of the text before, so
    the pieces' lengths give the places: within blocks of pieces first, then from block to block.
    """
    fenced = F.regexp_replace(text, pattern, f"{MARK}$0{INNER}{f'${group}' if group else ''}{MARK}")
    none = F.array().cast("array<struct<start:int,end:int,inner:int,text:string>>")

    def step(state: Column, piece: Column) -> Column:
        size = F.instr(piece, INNER) - 1
        match = F.struct(state["at"].alias("start"), (state["at"] + size).alias("end"), (F.length(piece) - size - 1).alias("inner"), F.substring(piece, F.lit(1), size).alias("text"))
        return (
            F.when(size >= 0, F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(match)).alias("out")))
            .otherwise(F.struct((state["at"] + F.length(piece)).alias("at"), state["out"].alias("out")))
        )

    def walked(pieces: Column) -> Column:
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def in_blocks(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(TOGETHER)), lambda i: walked(F.slice(pieces, i, TOGETHER)))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, places(F.transform(bs, lambda b: b["at"])), moved)))

    def places(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["inner"].alias("inner"), m["text"].alias("text")))

    split = lambda f: bound(F.split(f, MARK), lambda ps: F.when(F.size(ps) <= TOGETHER, walked(ps)["out"]).otherwise(in_blocks(ps)))
    return bound(fenced, lambda f: F.when(F.instr(f, MARK) == 0, none).otherwise(split(f)))


#: Counts of a window are kept five bits each, twelve to a number, by the character's code.
BITS, EACH = 5, 12
LOWEST, HIGHEST = ord("+"), ord("z")
NUMBERS = (HIGHEST - LOWEST) // EACH + 1


def windows_passing(run: Column, window: int = WINDOW, classes: list[tuple[str, str, float]] = CLASSES) -> Column:
    """(first, last) start of a window of ``run`` that reaches its class's entropy; first is null if none does.

    One pass over the run's characters, from ``LOWEST`` to ``HIGHEST``. The state holds each character's count in the window:
    the one that enters and the one that leaves change by one, and the sum of terms by as much. Windows have at most 31 characters.
    """
    if window >= 1 << BITS:
        raise ValueError("counts of such windows don't fit")
    steps = F.array(*[F.lit(term(n + 1) - term(n)) for n in range(window)])
    most = F.coalesce(*[F.when(run.rlike(pattern), F.lit(ceiling(bits, window))) for _, pattern, bits in classes], F.lit(-1))
    grown = lambda n: F.element_at(steps, (n + 1).cast("int"))
    place = lambda code: F.call_function("div", code, F.lit(EACH)).cast("int")
    shift = lambda code: ((code % EACH) * BITS).cast("int")
    count = lambda counts, code: F.call_function("shiftright", F.element_at(counts, place(code) + 1), shift(code)).bitwiseAND((1 << BITS) - 1)
    one = lambda k, code: F.when(k == place(code), F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))).otherwise(F.lit(0).cast("long"))

    def walk(codes: Column) -> Column:
        def slide(state: Column, code: Column) -> Column:
            leaves = F.when(state["at"] >= window, F.element_at(codes, F.greatest(state["at"] - window, F.lit(0)) + 1)).otherwise(-1)
            less = F.when(leaves < 0, state["sum"]).otherwise(state["sum"] - grown(F.greatest(count(state["counts"], F.greatest(leaves, F.lit(0))) - 1, F.lit(0))))
            inside = count(state["counts"], code) - F.when(leaves == code, 1).otherwise(0)
            counts = F.transform(state["counts"], lambda n, k: n + one(k, code) - F.when(leaves < 0, F.lit(0).cast("long")).otherwise(one(k, leaves)))
            total = (less + grown(inside)).cast("int")
            return F.struct((state["at"] + 1).alias("at"), counts.alias("counts"), total.alias("sum"), state["first"].alias("first"), state["last"].alias("last"), state["most"].alias("most"))

        def seen(state: Column) -> Column:
            begins = state["at"] - window
            ok = (begins >= 0) & (state["sum"] <= state["most"])
            return F.struct(
                state["at"].alias("at"), state["counts"].alias("counts"), state["sum"].alias("sum"),
                F.coalesce(state["first"], F.when(ok, begins)).alias("first"), F.when(ok, begins).otherwise(state["last"]).alias("last"), state["most"].alias("most"),
            )

        nowhere = F.lit(None).cast("int")
        start = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0).cast("long"), NUMBERS).alias("counts"), F.lit(0).alias("sum"), nowhere.alias("first"), nowhere.alias("last"), most.alias("most"))
        return F.aggregate(codes, start, lambda s, c: bound(slide(s, c), seen))

    return bound(F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.ascii(c) - LOWEST), walk)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: list[str] = ALLOWED, window: int = WINDOW, classes: list[tuple[str, str, float]] = CLASSES, keep: list[str] = ()) -> DataFrame:
    """(doc_id, found, *keep): the spans of each whole text as an array of (start, kind, end), kinds 0 to 3 as in KINDS, in order.

    Null and empty texts have none. A string that the entropy finds within or across a
    span of the fixed patterns isn't added again. Repeated rows are scanned again.
    """
    text = F.translate(whole("_text"), MARK + INNER, INSTEAD * 2)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(k) for k in keep])
    base = base.select("doc_id", *keep, text.alias("_text"))
    spans = base.select(
        "doc_id", *keep,
        F.filter(found(F.col("_text"), ASSIGN, 2), lambda m: m["inner"] >= 6).alias("_assign"),
        found(F.col("_text"), ACCESS).alias("_access"), found(F.col("_text"), HEX).alias("_hex"),
        F.filter(found(F.col("_text"), f"{CANDIDATE}"), lambda m: ~m["text"].rlike("|".join(f"(?:{a})" for a in allowed))).alias("_runs"),
    )
    kind = lambda name, n: F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))
    spans = spans.select("doc_id", *keep, F.concat(kind("_assign", 0), kind("_access", 1), kind("_hex", 2)).alias("_base"), "_runs")
    tried = F.transform("_runs", lambda m: F.struct(m["start"].alias("start"), windows_passing(m["text"], window, classes).alias("w")))
    hits = F.transform(F.filter(tried, lambda m: m["w"]["first"].isNotNull()), lambda m: F.struct((m["start"] + m["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + m["w"]["last"] + window).alias("end")))
    spans = spans.select("doc_id", *keep, "_base", F.when(F.size("_runs") > 0, hits).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("_hits"))
    new = F.filter("_hits", lambda h: ~F.exists("_base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    return spans.select("doc_id", *keep, F.array_sort(F.concat("_base", new)).alias("found"))


KINDS = ["assign", "access", "hex", "entropy"]


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")
    base = spans_text(F.filter("found", lambda s: s["kind"] < 3))
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


#: Characters of a stretch of text that is looked into at a time.
STRETCH = 4_096


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; spans are in order of start.

    The text is cut into stretches first and what stands between spans is gathered as pieces, which are joined once at the end.
    """

    def between(stretches: Column, a: Column, b: Column) -> Column:
        """The characters from place ``a`` up to ``b``, which is larger."""
        first, last = F.call_function("div", a, F.lit(STRETCH)).cast("int"), F.call_function("div", b - 1, F.lit(STRETCH)).cast("int")
        return F.substring(F.array_join(F.slice(stretches, first + 1, last - first + 1), ""), a - first * STRETCH + 1, b - a)

    def made(held: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            ahead = s["start"] > state["at"]
            fresh = (s["start"] >= state["at"]) | (state["at"] == 0)
            pieces = F.when(ahead, F.array(between(held["stretches"], state["at"], s["start"]), F.lit(mark))).when(fresh, F.array(F.lit(mark))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], pieces).alias("out"))

        def ended(state: Column) -> Column:
            rest = F.when(state["at"] < held["n"], F.array(between(held["stretches"], state["at"], held["n"]))).otherwise(F.array().cast("array<string>"))
            return F.array_join(F.concat(state["out"], rest), "")

        return bound(F.aggregate(held["spans"], F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step), ended)

    # Columns are named outside the lambdas only: within them a name may be taken for one that the same projection gives.
    whole_text = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("stretches"), F.length(text).alias("n"), spans.alias("spans"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(whole_text, made))
