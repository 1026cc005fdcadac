"""Archives (op 11), phrases (op 12) and ranked search (op 13) against brute force, with awkward rows."""

import collections
import gzip
import hashlib
import math
import re

import pytest

from quarrymill.llm import lexical, phrases, warc
from quarrymill.llm.shared import table_of_bits

from .fixtures import awkward_texts, docs_frame, empty_frame, prose

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, ordinal int")


LONG, OTHER = "<p>" + "long " * 40, "é" * 60
PAGES = [
    (5, "http://a.org/5", LONG), (3, "http://a.org/3", LONG), (9, "http://b.org/9?q=1#f", LONG), (4, None, OTHER), (2, "no scheme", OTHER), (7, "http://[bad/7", "short"), (8, "http://c.org/8\r\nEvil: 1", "short"),
    (1, "http://c.org/1", None), (6, "http://c.org/6", ""), (None, "http://d.org", LONG), (None, None, None), (3, "http://a.org/3", LONG), (10, "http://e.org/ü", "x" * 3_000_000), (11, "http://e.org/11", "WARC/1.1\r\n\r\n" * 20),
]


def expected_pages(rows):
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_archives_are_read_back_as_written(spark):
    got = warc.round_trip(pages_frame(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected_pages(PAGES)
    assert warc.round_trip(pages_frame(spark, [])).count() == 0


def test_captures_nest_their_records(spark, tmp_path):
    warc.write(pages_frame(spark, PAGES), f"file://{tmp_path}/w", roll=1000)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 1
    found = {r["response"]["target_uri"] if r["response"] else None: r for r in warc.captures(warc.read(spark, f"file://{tmp_path}/w")).collect()}
    r = found["http://b.org/9?q=1#f"]
    assert r["requests"][0]["fields"] == {"host": "b.org"} and r["metadata"][0]["fields"] == {"page-id": "9"} and r["response"]["type"] == "revisit" and r["response"]["refers_to_uri"] == "http://a.org/3"
    assert found["http://a.org/3"]["response"]["payload"] == LONG.encode() and found["http://c.org/8%0D%0AEvil:%201"]["response"]["payload"] == b"short"
    assert found["http://e.org/11"]["response"]["payload"] == b"WARC/1.1\r\n\r\n" * 20 and found["http://e.org/ü"]["response"]["payload_bytes"] == 3_000_000


def archive(tmp_path, records, name="foreign.warc.gz"):
    data = b"".join(warc.member([("WARC-Type", k), ("WARC-Record-ID", i), *[("WARC-Concurrent-To", o) for o in to], ("Content-Type", "application/warc-fields")], f"own: {i}\r\n".encode()) for k, i, to in records)
    (tmp_path / name).write_bytes(data if name.endswith("gz") else gzip.decompress(data))


def test_records_of_other_writers_are_joined_in_any_shape(spark, tmp_path):
    """The response names its request, metadata hangs on the request, and some records have no response at all."""
    archive(tmp_path, [("warcinfo", "i", []), ("request", "q1", []), ("response", "r1", ["q1"]), ("metadata", "m1", ["q1"]), ("metadata", "m2", ["m1"]), ("request", "q3", ["m3"]), ("metadata", "m3", []), ("response", "r2", [])])
    archive(tmp_path, [("request", "q2", ["r2"])], "plain.warc")
    got = {r["capture_id"]: (r["response"] and r["response"]["record_id"], [x["record_id"] for x in r["requests"] or []], [x["record_id"] for x in r["metadata"] or []]) for r in warc.captures(warc.read(spark, f"file://{tmp_path}")).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1", "m2"]), "r2": ("r2", ["q2"], []), "m3": (None, ["q3"], ["m3"])}


def test_a_capture_with_very_many_records_is_split(spark, tmp_path):
    archive(tmp_path, [("response", "r", []), *[("metadata", f"m{k}", ["r"]) for k in range(4500)]])
    rows = warc.captures(warc.read(spark, f"file://{tmp_path}")).collect()
    assert sum(len(r["metadata"]) for r in rows) == 4500 and max(len(r["metadata"]) for r in rows) < 1400 and [r["piece"] for r in rows if r["response"]] == [0]


def test_only_what_the_driver_has_listed_is_read(spark, tmp_path):
    warc.write(pages_frame(spark, PAGES[:3]), f"file://{tmp_path}/w")
    archive(tmp_path / "w", [("response", "stray", [])], "stray.warc.gz")
    assert warc.read(spark, f"file://{tmp_path}/w").filter("record_id = 'stray'").count() == 0


def test_a_torn_archive_is_an_error(spark, tmp_path):
    archive(tmp_path, [("response", "r", [])], "a.warc")
    (tmp_path / "a.warc").write_bytes((tmp_path / "a.warc").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, f"file://{tmp_path}").collect()


def phrases_by_hand(rows, max_n, least, absorbed, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        held = [b for (o, x), b in cand.items() if o == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if not any(100 * b >= absorbed * a for b in held):
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))  # noqa: E741


@pytest.mark.parametrize(("max_n", "least", "top", "bits"), [(3, 3, 2000, 1 << 27), (4, 2, 5, 1 << 15), (2, 1, 2000, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, max_n, least, top, bits):
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "STRETCH", 50)
    rows = [(prose(s, 30) + ". " + "New York City, new york city\tNEW YORK times! new york" * (s % 3), ["en", None, "und", "de"][s % 4]) for s in range(60)] + [(None, "en"), ("", None), (" \t\n", "fr"), ("É é\x00 É\x0bé \x00 x", "en"), ("a " * 500, "de")]
    frame = spark.createDataFrame([(t, g, "p", 1) for t, g in rows], "text string, lang string, phrase string, n int")
    real = phrases.counts
    monkeypatch.setattr(phrases, "counts", lambda docs, m, x: real(docs, m, x, bits))
    got = phrases.collocations(frame, max_n=max_n, least=least, absorbed=50, top=top).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, max_n, least, 50, top)
    assert phrases.collocations(empty_frame(spark)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    big = 10**12 + 7
    df = spark.createDataFrame([(big, big + 11, big + 13)], "a long, l long, r long")
    assert df.select(phrases.score(df.a, df.l, df.r)).first()[0] == 1_000_000 * big * big // ((big + 11) * (big + 13))


def test_bits_lie_at_their_places(spark):
    at = [0, 1, 7, 8, 32767, 32768, 99_999]
    bits = table_of_bits(spark.createDataFrame([(x,) for x in at * 2], "place long"), "place", 100_000)
    assert [p for p in range(100_000) if bits[p >> 3] >> (p & 7) & 1] == at


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_by_hand(docs, items, k):
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total, df = sum(1 for _, c in held if c), sum(c.total() for _, c in held), collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        own = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOWER))) if df[t]}
        scores = [(sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * n // total))) for t, w in own.items() if t in c), i) for i, c in held]
        best = sorted((-s, i is None, i or 0, i) for s, i in scores if s > 0)[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "postings"), [(8**4, 2_000_000), (8, 2_000_000), (70, 2_000_000), (8**4, 60)])
def test_search_equals_brute_force(spark, monkeypatch, shard, postings):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "STRETCH", 40)
    monkeypatch.setattr(lexical, "BLOCK", 3)
    docs = awkward_texts() + [(100 + s % 90, prose(s % 70, 20 + s % 9)) for s in range(300)] + [(None, prose(3, 25)), (None, prose(4, 25))]
    items = [(s, prose(s, 12)) for s in range(9)] + [(9, None), (10, ""), (11, "漢字 NAÏVE 12345"), (12, prose(5, 25)), (12, prose(5, 25)), (13, "zzz qqq unheard"), (None, prose(6, 25))]
    frame = spark.createDataFrame([(*r, "s", 1) for r in items], "item_id long, text string, term string, key long")
    got = lexical.ranked(docs_frame(spark, docs), frame).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == search_by_hand(docs, items, 10)


def test_search_over_whole_indexes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    items = spark.createDataFrame([(s, prose(s, 12)) for s in range(9)], "item_id long, text string")
    docs = [(s, prose(s, 20)) for s in range(50)]
    got = lexical.ranked(docs_frame(spark, docs), items).collect()
    assert sorted(map(tuple, got), key=str) == search_by_hand(docs, [(s, prose(s, 12)) for s in range(9)], 10)
    assert lexical.ranked(empty_frame(spark), items).count() == 0
    assert lexical.ranked(docs_frame(spark), items.limit(0)).count() == 0


def test_nodes_below_the_best_scores_stay_closed():
    """One short document in 4,096 holds the rare term: the search opens its path and few others."""
    import numpy as np

    docs = 8**4
    pos = np.concatenate([np.arange(docs), [1234]])
    term, impact = np.concatenate([np.zeros(docs, np.int64), [1]]), np.concatenate([np.arange(docs) % 7 + 1, [500]])
    tree, opened = lexical.Tree(docs, term, pos, impact, 2), []
    real = tree.levels
    tree.levels = [type("Level", (), {"shape": level.shape, "__getitem__": lambda self, at, level=level: opened.append(at) or level[at]})() for level in real]
    assert tree.best(np.array([0, 1]), np.array([1, 1000]), list(range(docs)), 1) == [(500_000 + 1234 % 7 + 1, 1234)]
    assert len(opened) < 12
