"""What the registered queries say, as DuckDB SQL over the same tables; queries that SQL can't say are not here.

Not here: op2 and op9 (a tokenizer), op6 (Spark's own hash places rows), op7
(random rounding). The tests hold them against plain versions.
"""

from __future__ import annotations

from itertools import permutations

from .license_model import COMMON, NOTICES, SCALE, features, trained
from .licenses import CONFIRM
from .mixing import MOST_COPIES, WEIGHTS
from .quality import RULES, mask
from .revisits import PERMITTED
from .secret_scan import ALPHABET, trained as trained_secrets

WORD = r"[^\x20\x09-\x0D]+"
TEXT = "coalesce(text, '')"


def _words(text: str = TEXT) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def revisits() -> str:
    bare = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^.*@', ''), '(:80|:443)$', ''), '^www\.', '')"
    path = rf"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = rf"list_sort(list_filter(string_split(regexp_extract({bare}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z_]*|gclid|fbclid|msclkid|dclid|mc_eid|igshid)(=|$)')))"
    url = f"CASE WHEN trim(url) <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    own = "'cache-control=max-age=60;content-type=none;date=t' || ts || CASE WHEN etag IS NULL THEN '' ELSE ';etag=W/\"' || etag || '\"' END || CASE WHEN modified IS NULL THEN '' ELSE ';last-modified=' || modified END"
    merged = "'cache-control=max-age=60;content-type=text/html;date=t' || ts || ';etag=' || CASE WHEN etag IS NULL THEN '\"' || stored_etag || '\"' ELSE 'W/\"' || etag || '\"' END || ';last-modified=' || coalesce(modified, stored_modified)"
    assert {"cache-control", "date", "etag", "last-modified"} <= set(PERMITTED)
    return f"""WITH p AS (SELECT page_id AS n, {url} AS key, sha256(coalesce(html, '')) AS digest, 'day ' || (page_id // 100) AS day FROM pages),
      res AS (SELECT 2 * n AS id, key, 10 * n AS ts, digest AS stored_digest, substr(digest, 1, 16) AS stored_etag, day AS stored_modified FROM p),
      rev AS (SELECT 2 * n + 1 AS record_id, key, 10 * n + 5 + (n % 7) * 50 - 100 AS ts, CASE WHEN n % 10 > 2 THEN substr(digest, 1, 16) END AS etag, CASE WHEN n % 10 = 0 THEN day END AS modified, CASE WHEN n % 10 = 1 THEN digest END AS digest FROM p),
      j AS (SELECT rev.*, res.id, stored_digest, stored_etag, stored_modified FROM rev LEFT JOIN res ON res.key = rev.key AND res.ts < rev.ts QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY res.ts DESC, res.id DESC) = 1),
      o AS (SELECT *, CASE WHEN id IS NULL THEN 'unanchored' WHEN etag IS NOT NULL THEN CASE WHEN etag = stored_etag THEN 'resolved' ELSE 'mismatch' END WHEN modified IS NOT NULL THEN CASE WHEN modified = stored_modified THEN 'resolved' ELSE 'mismatch' END
        WHEN digest IS NOT NULL THEN CASE WHEN digest = stored_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM j)
      SELECT record_id, key AS canonical_url, ts, id AS response_id, outcome, CASE WHEN outcome IN ('resolved', 'unverified') THEN stored_digest ELSE digest END AS payload_digest, CASE WHEN outcome IN ('resolved', 'unverified') THEN {merged} ELSE {own} END AS headers FROM o"""


def repeats(size: int = 50) -> str:
    return f"""WITH d AS (SELECT doc_id, {_words()} AS w FROM documents),
      win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {size - 1}), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d WHERE len(w) >= {size})),
      gone AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY 1) USING (h) WHERE doc_id > first),
      words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
      hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS i FROM gone)
      SELECT doc_id, any_value(len(w)) AS n_words, count(hit.i) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY words.i) FILTER (WHERE hit.i IS NULL), '')) AS kept_sha256
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN hit USING (doc_id, i) GROUP BY 1"""


def licenses() -> str:
    m = trained()
    split = r"list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: w <> '')"
    weights = ", ".join(f"('{f}', {k}, {x}::BIGINT)" for f, w in m.weights.items() for k, x in enumerate(w))
    bias = ", ".join(f"({k}, {b}::BIGINT, '{n}')" for k, (b, n) in enumerate(zip(m.bias, m.families, strict=True)))
    notices = ", ".join(f"('{n}', {i}, '{f}')" for n, texts in NOTICES.items() for i, t in enumerate(texts) for f in sorted(features(t)))
    assert COMMON
    return rf"""WITH weight(f, k, x) AS (VALUES {weights}), family(k, b, name) AS (VALUES {bias}), notice(name, i, f) AS (VALUES {notices}),
      line AS (SELECT doc_id, unnest(string_split({TEXT}, chr(10))) AS x, unnest(range(len(string_split({TEXT}, chr(10))))) AS n FROM documents),
      word AS (SELECT doc_id, n, {split} AS w FROM line), evident AS (SELECT * FROM word WHERE len(w) > 0),
      found AS (SELECT DISTINCT doc_id, n, f FROM (SELECT doc_id, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM evident)),
      score AS (SELECT doc_id, n, family.k, any_value(name) AS name, any_value(b) + coalesce(sum(weight.x), 0) AS s FROM evident CROSS JOIN family LEFT JOIN found USING (doc_id, n) LEFT JOIN weight ON weight.f = found.f AND weight.k = family.k GROUP BY 1, 2, 3),
      top AS (SELECT doc_id, n, arg_max(name, (s, -k)) AS name, max(s) AS s FROM score GROUP BY 1, 2),
      judged AS (SELECT doc_id, n, top.name, 1.0 / sum(exp((score.s - top.s)::DOUBLE / {SCALE})) AS p FROM top JOIN score USING (doc_id, n) GROUP BY 1, 2, 3),
      predicted AS (SELECT * FROM judged WHERE name <> '{m.families[0]}' AND p >= {m.threshold}),
      sure AS (SELECT DISTINCT doc_id, n, name, p FROM (SELECT doc_id, n, p.name, p, i, count(found.f) AS hit, count(*) AS size FROM predicted p JOIN notice USING (name) LEFT JOIN found USING (doc_id, n, f) GROUP BY 1, 2, 3, 4, 5) WHERE hit >= {CONFIRM} * size),
      per AS (SELECT doc_id, count(*) AS n_confirmed, array_to_string(list_sort(list_distinct(list(name))), ',') AS families, arg_max(name, (p, -n)) AS top_family, max(p) AS p FROM sure GROUP BY 1)
      SELECT doc_id, (SELECT count(*) FROM line l WHERE l.doc_id = d.doc_id AND regexp_matches(x, '{WORD}')) AS n_paragraphs, (SELECT count(*) FROM predicted q WHERE q.doc_id = d.doc_id) AS n_predicted, coalesce(n_confirmed, 0) AS n_confirmed,
      coalesce(families, '') AS families, coalesce(top_family, '') AS top_family, round(coalesce(p, 0.0), 4) AS top_probability FROM documents d LEFT JOIN per USING (doc_id)"""


EXACT = rf"""WITH d AS (SELECT doc_id, length({TEXT}) AS n, regexp_replace({TEXT}, '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)"""


#: The rules again, as SQL; a rule's place is its bit.
FAILS = (
    "n_words < 50",
    "100 * n_repeat_words > 50 * n_words",
    "10 * n_symbols > n_words",
    "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines",
    "n_words > 0 AND (word_chars > 25 * n_words OR word_chars < 2 * n_words)",
    "n_upper > n_lower",
    "4 * n_exclaimed > n_words",
    "n_words = 0",
)


def _ledger() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, fails in enumerate(FAILS))
    return rf"""WITH d AS (SELECT doc_id, {TEXT} AS t, {_words()} AS w FROM documents),
      words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
      win AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS h FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      again AS (SELECT doc_id, i FROM win WHERE h IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
      rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY 1),
      m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower, len(regexp_extract_all(t, '!')) AS n_exclaimed FROM d LEFT JOIN rep USING (doc_id)),
      f AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m), g AS (SELECT *, ({bits})::BIGINT AS failed FROM f)"""


def quality(policy: int = 2) -> str:
    own = f"(failed & {mask(policy) | mask(1)})"
    return rf"""{_ledger()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_lower, n_exclaimed, (failed & {mask(1)}) <> 0 AS base_failed, {own} = 0 AS kept, failed, {policy} AS policy,
      CASE WHEN bit_count({own}) = 1 THEN {own} ELSE 0 END AS only_rule FROM g"""


def ablations(policy: int = 2) -> str:
    rules = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES))
    return rf"""{_ledger()}, rule(rule, bit) AS (VALUES {rules})
      SELECT rule, (bit & {mask(policy)}) <> 0 AS enforced, count(*) FILTER (WHERE failed & bit <> 0) AS failing, count(*) FILTER (WHERE failed & {mask(policy)} = bit) AS alone,
      count(*) FILTER (WHERE (failed & {mask(policy)} & ~bit) = 0) AS without_it FROM g CROSS JOIN rule GROUP BY rule, bit"""


def targets(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> str:
    """Water filling step by step: a round caps every source whose share of the rest is above its cap, until none is."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""WITH RECURSIVE s AS (SELECT source, sum(len({_words()}))::BIGINT AS source_size FROM documents GROUP BY 1),
      w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight FROM s),
      r AS (SELECT 0 AS step, source, source_size, weight, false AS capped FROM w
        UNION ALL SELECT step + 1, source, source_size, weight, capped OR ((SELECT sum(source_size) FROM w) - sum(CASE WHEN capped THEN {most} * source_size ELSE 0 END) OVER ()) * weight > {most} * source_size * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()
        FROM r WHERE step < (SELECT count(*) FROM w)),
      last AS (SELECT * FROM r WHERE step = (SELECT count(*) FROM w))
      SELECT source, source_size, round(CASE WHEN capped THEN {most} * source_size ELSE ((SELECT sum(source_size) FROM w) - sum(CASE WHEN capped THEN {most} * source_size ELSE 0 END) OVER ())::DOUBLE * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END, 3) AS target FROM last"""


def near(size: int = 3, percent: int = 85) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(lower)} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, md5(x) AS x FROM (SELECT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + {size - 1}), ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM d WHERE len(w) > 0))),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b USING (x) WHERE a.doc_id > b.doc_id GROUP BY 1, 2),
      link AS (SELECT u, v FROM pair JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * shared >= {percent} * (nu.n + nv.n - shared)), edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
      reach AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u)
      SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, min(v)) AS component_id, doc_id = least(doc_id, min(v)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.u = doc_id GROUP BY doc_id"""


#: The kinds of secrets in their order, their patterns, and the fewest characters of a match or of its second group.
SECRETS = {
    "assign": ("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": ("(A)(KIA[A-Z0-9]+)", 17),
    "hex": ("()([0-9a-f]+)", 16),
    "markov": ("()([A-Za-z0-9+/_=-]{20,})", 20),
}


def secrets() -> str:
    """Where matches lie follows from the lengths of matches and of what stands between them."""
    m = trained_secrets()
    places = []
    for k, (kind, (pattern, least)) in enumerate(SECRETS.items()):
        quoted = pattern.replace("'", "''")
        places.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, x, y, sum(length(gap) + coalesce(length(prior), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS a, {least} AS least FROM
          (SELECT doc_id, i, hits[i] AS x, ends[i] AS y, gaps[i] AS gap, hits[i - 1] AS prior FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM
          (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', 2) AS ends, regexp_split_to_array(t, '{quoted}') AS gaps FROM d)))""")
    place = f"(strpos('{ALPHABET}', substr(x, %s, 1)) - 1)"
    score = f"list_sum(list_transform(range(1, length(x)), lambda i: ratios[{place % 'i'} * {len(ALPHABET)} + {place % 'i + 1'} + 1]))"
    shown = "string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k)"
    return f"""WITH model AS (SELECT {list(m.ratios)} AS ratios), d AS (SELECT doc_id, {TEXT} AS t FROM documents),
      hit AS (SELECT doc_id, k, kind, x, a, a + length(x) AS b FROM ({' UNION ALL '.join(places)}) WHERE length(y) >= least),
      base AS (SELECT * FROM hit WHERE k < 3),
      more AS (SELECT hit.* FROM hit, model WHERE k = 3 AND {score} >= {m.threshold} AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = hit.doc_id AND base.a <= hit.a AND base.b >= hit.b)),
      every AS (SELECT * FROM base UNION ALL SELECT * FROM more)
      SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_markov,
      sha256(coalesce({shown} FILTER (WHERE k < 3), '')) AS base_sha256, coalesce({shown}, '') AS spans FROM d LEFT JOIN every USING (doc_id) GROUP BY doc_id"""


def ranked(k: int = 20) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {found} AS w FROM documents), n AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
      tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY 1, 2),
      weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, docs),
      q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({found}) AS t FROM benchmark) GROUP BY 1, 2),
      s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN weight USING (t) JOIN n USING (doc_id), total GROUP BY 1, 2)
      SELECT item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {k}"""


def interactions() -> str:
    """Every document goes through every order; no matrices."""
    letters = "ABCDE"
    tried = ", ".join(f"('{''.join(p)}', {s + 1}, {1 << letters.index(p[s])}, {sum(1 << letters.index(x) for x in p[:s])})" for p in permutations(letters) for s in range(5))
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, {TEXT} AS t, {_words()} AS w FROM documents),
      said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
      f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d LEFT JOIN said USING (doc_id)),
      h AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL), o(filter_order, step, own, before) AS (VALUES {tried}),
      r AS (SELECT part, filter_order, step, own, (coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0))::BIGINT AS removed, (coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0))::BIGINT AS redundant,
        (coalesce(sum(n) FILTER (WHERE mask = own), 0))::BIGINT AS unique_fails, (coalesce(sum(n) FILTER (WHERE good AND mask & own <> 0 AND mask & before = 0), 0))::BIGINT AS good_lost, (coalesce(sum(n) FILTER (WHERE toxic AND mask & own <> 0 AND mask & before = 0), 0))::BIGINT AS toxic_lost FROM h CROSS JOIN o GROUP BY 1, 2, 3, 4)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


SQL: dict[str, str] = {
    "op1_resolve_revisits": revisits(),
    "op3_substring_dedup": repeats(),
    "op4_license_scan": licenses(),
    "op5_exact_dedup": EXACT,
    "op8_quality_rules": quality(),
    "quality_ablations": ablations(),
    "mixing_targets": targets(),
    "op10_near_dedup": near(),
    "op11_find_secrets": secrets(),
    "op12_ranked_search": ranked(),
    "op13_filter_audit": interactions(),
}
