"""Benchmark items asked again: in another case, with other values, with words put in; against a plain version."""

import random

from quarrymill.llm import decontaminate

from .fixtures import docs_frame, prose

ITEM = "Anna has 12 apples and gives 5 apples to her friend Bob before walking 3 km to the old market square today"


def found(spark, texts, items):
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_frame(spark, list(enumerate(texts))), frame).collect()}


def test_any_case(spark):
    texts = [prose(1, 60) + " " + ITEM.upper() + " " + prose(2, 60), "so " + ITEM.lower(), (prose(3, 20) + " " + ITEM).upper(), prose(4, 80).upper()]
    assert found(spark, texts, [ITEM]) == {(0, 0), (1, 0), (2, 0)}


def test_slots_of_other_lengths_and_words_put_in(spark):
    item = "once Tom bought 12 boxes of pencils at the corner shop and then Tom sold 30 of them to the school next door before the long summer holiday began"
    other = item.replace("12", "1,200").replace("30", "4,400").replace("Tom sold", "Mary Ann sold").replace("Tom bought", "Mary Ann bought")
    put_in = item.replace("and then Tom", "and just then Tom")
    texts = [prose(1, 40) + " " + other + " " + prose(2, 40), prose(3, 40) + " " + put_in, prose(5, 90)]
    assert found(spark, texts, [item]) == {(0, 0), (1, 0)}


def test_runs_are_joined(spark):
    row = spark.createDataFrame([(1, "then Mary Ann Smith paid 1,200 to Bob. Carl went 3 4 5 km off, $7 or twelve EUROS. The end")], "id long, _text string")
    made = decontaminate.read(row, "id", "template").first()
    assert made["t"] == ["then", "<name>", "paid", "<number>", "to", "<name>", "<name>", "went", "<number>", "<unit>", "off", "<number>", "or", "<number>", "<unit>", "<name>", "end"]
    assert [v for v in made["v"] if v] == ["<name>mary", "<number>1200", "<name>bob", "<open>carl", "<number>3", "<unit>km", "<number>$7", "<number>twelve", "<unit>euros", "<open>the"]
    words = decontaminate.read(row, "id", "literal").first()
    assert words["t"][:6] == ["then", "mary", "ann", "smith", "paid", "1200"] and not any(words["v"])


NAMES, OTHERS = "Sarah Tom Anna Bob Natalia Carl".split(), ["Maria", "Wu", "Mary Ann", "Kurt", "Zoe Lee", "Igor"]


def question(r, k):
    """A made-up question with names (some open sentences), prices, numbers as digits and words, and units; and it asked again."""
    values = {"a": r.choice(NAMES[:3]), "b": r.choice(NAMES[3:]), "n": str(r.randrange(2, 40)), "m": r.choice(["twelve", "seven", "30"]), "p": f"${r.randrange(2, 9)}", "u": r.choice(["km", "miles", "hours"])}
    again = {"a": r.choice(OTHERS[:3]), "b": r.choice(OTHERS[3:]), "n": r.choice(["1,200", "41", "sixty"]), "m": r.choice(["45", "nine"]), "p": f"${r.randrange(10, 90)}", "u": "minutes"}
    w = prose(5000 + k, 30).split()
    form = f"{{a}} bought {{n}} {' '.join(w[:5])} for {{p}} each {w[5]}. {w[6].capitalize()} {w[7]} {{b}} {' '.join(w[8:13])} after {{m}} {{u}} and {' '.join(w[13:20])}. How many {w[20]} does {{a}} {' '.join(w[21:26])}?"
    return form.format(**values), form.format(**again)


def test_recall_of_questions_asked_again(spark):
    r = random.Random(11)
    asked = [question(r, k) for k in range(60)]
    texts = [f"{prose(100 + k, 40)} {again} {prose(300 + k, 40)}" for k, (_, again) in enumerate(asked)]
    # Also the same questions with the values mixed up: one name for two persons breaks nothing, two names for one do.
    texts += [prose(700 + k, 100) for k in range(60)]
    got = found(spark, texts, [item for item, _ in asked])
    right = {(k, k) for k in range(60)}
    print("recall of questions asked again", len(got & right) / 60)
    assert len(got & right) >= 54 and not got - right


def plain_found(text, item, way):
    """Windows of the item met in one occurrence, by hand."""
    import re

    def read(t):
        for _ in range(2):
            t = re.sub(r"([0-9]),([0-9]{3})", r"\1\2", t)
        words = [w for w in re.split(r"(?:(?![.!?%€$])[\W_])+", t) if w.rstrip(".!?")]
        out, before, last = [], None, None
        for w in words:
            low = w.rstrip(".!?").lower()
            numeric = lambda x: bool(re.match(r"[€$]?[0-9]", x)) or x.rstrip(".!?").lower() in decontaminate.NUMBER_WORDS
            kind = None
            if way == "template":
                if numeric(w):
                    kind = "<number>"
                elif before is not None and numeric(before) and low in decontaminate.UNITS:
                    kind = "<unit>"
                elif w[0].isupper() and (any(c.islower() for c in w) or len(low) == 1):
                    kind = "<open>" if before is None or before[-1] in ".!?" else "<name>"
            goes_on = kind == last == "<number>" or kind == "<name>" and last in ("<name>", "<open>")
            if not goes_on:
                out.append(("<name>" if kind == "<open>" else kind or low, kind and kind + low))
            before, last = w, kind
        return out

    a, b = read(text), read(item)
    n = min(8, len(b))
    windows = [i for i in range(len(b) - n + 1) if n and sum(v is None for _, v in b[i : i + n]) >= min(5, n)]
    met = [(i, j) for i in windows for j in range(len(a) - n + 1) if [t for t, _ in a[j : j + n]] == [t for t, _ in b[i : i + n]]]
    best = 0
    for spread in (0, 3):
        for d in {j - i + o for i, j in met for o in range(-spread, spread + 1)}:
            here = [(i, j) for i, j in met if abs(j - i - d) <= spread]
            values = {(v[1], u[1]) for i, j in here for v, u in zip(b[i : i + n], a[j : j + n], strict=True) if v[1] and "<open>" not in v[1] + u[1]}
            if len({v for v, _ in values}) == len(values):
                best = max(best, len({i for i, _ in here}))
    return best if windows and best >= 0.5 * len(windows) else 0


def test_against_a_plain_version(spark):
    r = random.Random(21)
    asked = [question(r, k) for k in range(8)] + [("why is water wet today", "Why is water wet today"), ("Add 1 2 3 now", "so Add 4 now"), ("x", "x"), ("...", "...")]
    texts = [again for _, again in asked] + [item.upper() for item, _ in asked] + [f"{prose(k, 20)} {asked[k % 8][0]} {asked[(k + 1) % 8][1]}" for k in range(8)]
    for k in range(10):
        words = asked[k % 8][0].split()
        for _ in range(k):
            words[r.randrange(len(words))] = r.choice(["zz", "Zz", "9", "$4", "km"])
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["template_windows"], x["literal_windows"]) for x in decontaminate.contaminated(docs_frame(spark, list(enumerate(texts))), frame).collect()}
    want = {(i, k): (plain_found(t, item, "template"), plain_found(t, item, "literal")) for i, t in enumerate(texts) for k, (item, _) in enumerate(asked)}
    assert got == {k: v for k, v in want.items() if any(v)}


def test_anchors_lose_nothing(spark):
    """With the texts looked over first, and without."""
    r = random.Random(31)
    items = [question(r, k)[0] for k in range(5)]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    theirs = decontaminate.items_windows(frame, "template")
    anchors = decontaminate.anchors(theirs)
    assert anchors[3] and not anchors[1]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate([*items, " ".join(reversed(items[0].split())), prose(1, 50), ""])], "id long, _text string")
    assert {x["id"] for x in decontaminate.anchored(texts, "id", anchors).collect()} == set(range(5))
    # A window without any word of letters makes every text be read.
    numbers = spark.createDataFrame([(1, "a1 b2 c3")], "item_id long, text string")
    assert decontaminate.anchors(decontaminate.items_windows(numbers, "template")) is None
    assert found(spark, ["so a1 b2, C3 then", "a1 c3"], ["a1 b2 c3"]) == {(0, 0)}


def test_short_and_dense_items(spark):
    items = ["why is water wet today", "Natalia sold clips to many of her friends", "Add 1 2 3 4 5 6 7 8 9 10 now"]
    texts = [f"{prose(k, 30)} {item}, {prose(k + 50, 30)}" for k, item in enumerate(items)] + [prose(9, 80)]
    assert found(spark, texts, items) == {(0, 0), (1, 1), (2, 2)}
