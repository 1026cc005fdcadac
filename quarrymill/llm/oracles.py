"""SQL for DuckDB that gives the same rows as the queries SQL can express, in another form than they have.

What the contracts fix (rules of op 2, patterns of op 5) is written out here once more. What the methods chose for
themselves (candidate classes, allow-list, units) is named from the operators, as both sides must mean the same.
The other queries are held against brute force, public libraries or held-out labels in tests/llm.
"""

from __future__ import annotations

from . import decontaminate as d
from . import secretscan as s

# Fixed values of the contracts.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def redirects() -> str:
    after = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = lambda x: f"translate(regexp_extract({after.format(x)}, '^[^/?#]*'), '{CAPITALS}', '{SMALL}')"
    path = lambda x: f"regexp_extract({after.format(x)}, '^[^/?#]*([^?#]*)', 1)"
    node = lambda x: f"CASE WHEN {host(x)} <> '' THEN {host(x)} || regexp_extract({after.format(x)}, '^[^/?#]*([^#]*)', 1) END"
    rules = sorted(RULES, key=lambda r: -len(r[1]))

    def decided(h: str, p: str, give: int) -> str:
        cases = []
        for rule in rules:
            name, slash, rest = rule[1].partition("/")
            cases.append(f"WHEN ({h} = {text(name)} OR ends_with({h}, {text('.' + name)})) AND starts_with({p}, {text(slash + rest)}) THEN {text(rule[give])}")
        return "CASE " + " ".join(cases) + " END"

    link = r"""(?is)<link\b[^>]*>"""
    meta = r"""(?is)<meta\b[^>]*>"""
    href = r"""(?is)\shref\s*=\s*["']?\s*([^"'>]*?)\s*["'>]"""
    refresh = r"""(?is)url\s*=\s*["']?\s*([^"'>\s]+)"""
    is_link, is_meta = r"""(?is)\srel\s*=\s*["']?\s*canonical\b""", r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
    root = f"regexp_extract(url, '^[^:]*') || '://' || regexp_extract({after.format('url')}, '^[^/?#]*')"
    folder = f"CASE WHEN regexp_replace({path('url')}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({path('url')}, '[^/]*$', '') END"
    return f"""WITH RECURSIVE found AS (
      SELECT url, unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(coalesce(html, ''), {text(link)}), lambda t: regexp_matches(t, {text(is_link)})), lambda t: regexp_extract(t, {text(href)}, 1)),
        list_transform(list_filter(regexp_extract_all(coalesce(html, ''), {text(meta)}), lambda t: regexp_matches(t, {text(is_meta)})), lambda t: regexp_extract(t, {text(refresh)}, 1)))) AS href
      FROM pages),
    full_urls AS (SELECT url AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:]*') || ':' || href
        WHEN starts_with(href, '/') THEN {root} || href WHEN starts_with(href, '?') THEN {root} || {path('url')} || href
        WHEN starts_with(href, '#') OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE {root} || {folder} || href END AS b FROM found WHERE href <> ''),
    e AS (SELECT {node('a')} AS a, {node('b')} AS b FROM full_urls), both_ways AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
    reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other),
    said AS (SELECT node, {decided(host("('x://' || other)"), path("('x://' || other)"), 0)} AS v FROM reach),
    blocked AS (SELECT node FROM said GROUP BY node HAVING bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), FALSE)),
    p AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))
    SELECT page_id, host, path, {decided('host', 'path', 1)} AS rule, coalesce({decided('host', 'path', 0)}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


def secrets() -> str:
    kinds = [(ASSIGN, r"\2"), (ACCESS, ""), (HEX, ""), (s.CANDIDATE, "")]
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, string_split(regexp_replace(t, {text(p)}, chr(1) || '\\0' || chr(2) || '{g}' || chr(1), 'g'), chr(1)) AS pieces FROM docs" for k, (p, g) in enumerate(kinds))
    allowed = "|".join(f"(?:{a})" for a in s.ALLOWED)
    most = "CASE " + " ".join(f"WHEN regexp_matches(x, {text(p)}) THEN {s.ceiling(b)}" for _, p, b in s.CLASSES) + " ELSE -1 END"
    terms = "[" + ", ".join(str(s.term(n)) for n in range(s.WINDOW + 1)) + "]"
    name = "CASE k " + " ".join(f"WHEN {k} THEN {text(n)}" for k, n in enumerate(s.KINDS)) + " END || ':' || a || ':' || b"
    return f"""WITH docs AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)) AS t FROM documents),
    p AS (SELECT doc_id, k, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM ({each})),
    q AS (SELECT *, CASE WHEN contains(piece, chr(2)) THEN instr(piece, chr(2)) - 1 ELSE length(piece) END AS n FROM p),
    m AS (SELECT doc_id, k, CAST(sum(n) OVER (PARTITION BY doc_id, k ORDER BY i) - n AS BIGINT) AS a, n, length(piece) - n - 1 AS inner_n, substr(piece, 1, n) AS x, contains(piece, chr(2)) AS hit FROM q),
    base AS (SELECT doc_id, k, a, a + n AS b FROM m WHERE hit AND (k = 0 AND inner_n >= 6 OR k = 1 AND n >= 20 OR k = 2 AND n >= 24)),
    runs AS (SELECT doc_id, a, x, {most} AS most FROM m WHERE hit AND k = 3 AND NOT regexp_matches(x, {text(allowed)})),
    win AS (SELECT doc_id, a, most, w, string_split(substr(x, CAST(w + 1 AS INTEGER), {s.WINDOW}), '') AS c FROM (SELECT *, unnest(range(0, length(x) - {s.WINDOW} + 1)) AS w FROM runs)),
    good AS (SELECT doc_id, a, w FROM win WHERE list_sum(list_transform(list_distinct(c), lambda y: {terms}[len(list_filter(c, lambda z: z = y)) + 1])) <= most),
    extra AS (SELECT doc_id, 3 AS k, a + min(w) AS a, a + max(w) + {s.WINDOW} AS b FROM good GROUP BY doc_id, a),
    fresh AS (SELECT * FROM extra e WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = e.doc_id AND x.a < e.b AND e.a < x.b)),
    spans AS (SELECT * FROM base UNION ALL SELECT * FROM fresh),
    said AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce(string_agg({name}, ',' ORDER BY a, k, b) FILTER (k < 3), '') AS base_text, string_agg({name}, ',' ORDER BY a, k, b) AS spans FROM spans GROUP BY doc_id)
    SELECT o.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents o LEFT JOIN said ON said.doc_id = o.doc_id"""


def templates() -> str:
    units, numbers = (", ".join(text(x) for x in xs) for xs in (d.UNITS, d.NUMBER_WORDS))
    numeric = lambda w, low: f"coalesce(regexp_matches({w}, '^[€$]?[0-9]') OR {low} IN ({numbers}), FALSE)"
    digits = "regexp_replace({0}, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"

    def words(table: str, key: str) -> str:
        grouped = digits.format(digits.format("coalesce(text, '')"))
        split = f"list_filter(string_split_regex({grouped}, '[^\\p{{L}}\\p{{N}}.!?%€$]+'), lambda x: length(rtrim(x, '.!?')) > 0)"
        each = f"SELECT key, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT {key} AS key, {split} AS w FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL))"
        return f"SELECT *, lower(rtrim(word, '.!?')) AS low, lag(word) OVER (PARTITION BY key ORDER BY i) AS prior FROM ({each})"

    def template(table: str, key: str) -> str:
        named = "regexp_matches(word, '^\\p{Lu}') AND (regexp_matches(word, '\\p{Ll}') OR length(low) = 1)"
        before = numeric("prior", "lower(rtrim(prior, '.!?'))")
        kind = f"CASE WHEN {numeric('word', 'low')} THEN '{d.NUMBER}' WHEN {before} AND low IN ({units}) THEN '{d.UNIT}' WHEN {named} AND (prior IS NULL OR regexp_matches(prior, '[.!?]$')) THEN '{d.OPEN}' WHEN {named} THEN '{d.NAME}' END"
        kinds = f"SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY i) AS last FROM (SELECT *, {kind} AS kind FROM ({words(table, key)}))"
        kept = f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) AS place, CASE WHEN kind = '{d.OPEN}' THEN '{d.NAME}' ELSE coalesce(kind, low) END AS t, kind || low AS v FROM ({kinds}) WHERE NOT coalesce(kind = '{d.NUMBER}' AND last = '{d.NUMBER}' OR kind = '{d.NAME}' AND last IN ('{d.NAME}', '{d.OPEN}'), FALSE)"
        return f"SELECT key, list(t ORDER BY place) AS t, list(v ORDER BY place) AS v FROM ({kept}) GROUP BY key"

    def literal(table: str, key: str) -> str:
        return f"SELECT key, list(low ORDER BY i) AS t, list(CAST(NULL AS VARCHAR) ORDER BY i) AS v FROM ({words(table, key)}) GROUP BY key"

    def windows(read: str, sizes: str) -> str:
        placed = f"SELECT *, unnest(range(1, len(t) - size + 2)) AS place FROM (SELECT r.*, s.size FROM ({read}) r JOIN ({sizes}) s ON s.size <= len(r.t))"
        return f"SELECT key, size, place, array_to_string(list_slice(t, place, place + size - 1), ' ') AS template, list_filter(list_slice(v, place, place + size - 1), lambda x: x IS NOT NULL) AS slots FROM ({placed})"

    def found(way: str, read) -> str:
        own = f"SELECT key AS item_id, place, size, template, slots FROM ({windows(read('benchmark', 'item_id'), f'SELECT unnest(range(1, {d.WINDOW} + 1)) AS size')}) w JOIN (SELECT key AS k, least(len(t), {d.WINDOW}) AS own FROM ({read('benchmark', 'item_id')})) o ON o.k = w.key AND o.own = w.size WHERE size - len(slots) >= least({d.LITERALS}, size)"
        return f"""{way}_theirs AS MATERIALIZED ({own}), {way}_totals AS (SELECT item_id, count(*) AS item_windows FROM {way}_theirs GROUP BY item_id),
        {way}_met AS (SELECT m.key AS doc_id, t.item_id, m.place - t.place AS diagonal, t.place, t.slots AS theirs, m.slots AS mine FROM ({windows(read('documents', 'doc_id'), f'SELECT DISTINCT size FROM {way}_theirs')}) m JOIN {way}_theirs t ON t.template = m.template AND t.size = m.size),
        {way}_near AS (SELECT doc_id, item_id, diagonal, FALSE AS wide, place, theirs, mine FROM {way}_met UNION ALL SELECT doc_id, item_id, diagonal + o, TRUE, place, theirs, mine FROM {way}_met, (SELECT unnest(range(-{d.SPREAD}, {d.SPREAD} + 1)) AS o)),
        {way}_pairs AS (SELECT DISTINCT doc_id, item_id, diagonal, wide, a, b FROM (SELECT doc_id, item_id, diagonal, wide, unnest(theirs) AS a, unnest(mine) AS b FROM {way}_near) WHERE NOT starts_with(a, '{d.OPEN}') AND NOT starts_with(b, '{d.OPEN}')),
        {way}_odd AS (SELECT doc_id, item_id, diagonal, wide FROM {way}_pairs GROUP BY ALL HAVING count(*) > count(DISTINCT a)),
        {way}_best AS (SELECT doc_id, item_id, max(n) AS n FROM (SELECT doc_id, item_id, diagonal, wide, count(DISTINCT place) AS n FROM {way}_near GROUP BY ALL) c ANTI JOIN {way}_odd USING (doc_id, item_id, diagonal, wide) GROUP BY doc_id, item_id),
        {way}_found AS (SELECT doc_id, item_id, n FROM {way}_best JOIN {way}_totals USING (item_id) WHERE n >= item_windows * {d.COVERAGE})"""

    return f"""WITH {found('template', template)}, {found('literal', literal)}
    SELECT doc_id, item_id, CAST(coalesce(t.n, 0) AS BIGINT) AS template_windows, CAST(coalesce(l.n, 0) AS BIGINT) AS literal_windows FROM template_found t FULL JOIN literal_found l USING (doc_id, item_id)"""


def transactions() -> str:
    return """WITH q AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q), r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM m)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""


def phrases() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) AS phrase FROM w" for k in (1, 2, 3))
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS c FROM ({grams}) GROUP BY ALL),
    words AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k AS size, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 10),
    cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM cand),
    scored AS (SELECT x.lang, x.phrase, x.a, x.size, x.ws, y.c AS l, z.c AS r, x.cut, (CAST(1000000 AS HUGEINT) * x.a * x.a) // (CAST(y.c AS HUGEINT) * z.c) AS score FROM cuts x
      JOIN f y ON y.lang = x.lang AND y.phrase = array_to_string(x.ws[1:x.cut], ' ') JOIN f z ON z.lang = x.lang AND z.phrase = array_to_string(x.ws[x.cut + 1:x.size], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    gone AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN cand c ON c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 50 * b.a AND (c.ws[1:2] = b.ws OR c.ws[2:3] = b.ws))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, words.n, CAST(b.score AS BIGINT) AS score
      FROM best b JOIN words ON words.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = b.lang AND g.phrase = b.phrase)) WHERE rank <= 2000"""


def lexical() -> str:
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {found} AS ts FROM documents), whole AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d),
    tf AS (SELECT k, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
    i AS (SELECT row_number() OVER () AS key, item_id, list_distinct({found}) AS ts FROM benchmark), it AS (SELECT key, item_id, unnest(ts) AS t FROM i),
    w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY t),
    s AS (SELECT key, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM it JOIN w USING (t) JOIN tf USING (t), whole GROUP BY key, item_id, k, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


ORACLES: dict[str, str] = {
    "op2_redirect_equivalence": redirects(), "op5_entropy_secrets": secrets(), "op6_template_decontamination": templates(),
    "op11_warc_transactions": transactions(), "op12_phrase_collocations": phrases(), "op13_max_tree_search": lexical(),
}
