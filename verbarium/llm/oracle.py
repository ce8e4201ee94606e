"""SQL for the queries that SQL can express, by plainer means than the operators use."""

from __future__ import annotations

import re

from verbarium.llm import embeddings, licenses, mixing, prefix_trie, rules, superkmers

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def op1_mixing() -> str:
    weights = ", ".join(f"{w}.0" for w in mixing.WEIGHTS)

    def takes(budget: str) -> str:
        return f"CASE WHEN upto - words < {budget} AND upto - {budget} <= {budget} - upto + words THEN size ELSE 0 END"

    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM hashed GROUP BY source),
weighed AS (
  SELECT *, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w,
    CAST(source_size * {mixing.MOST} AS DOUBLE) AS capacity, CAST(sum(source_size) OVER () * {mixing.SHARE} AS DOUBLE) AS budget FROM sums),
ranked AS (
  SELECT *, sum(w) OVER () AS all_w,
    coalesce(sum(capacity) OVER past, 0) AS given, coalesce(sum(w) OVER past, 0) AS used FROM weighed
  WINDOW past AS (ORDER BY capacity / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, capacity * (all_w - used) <= w * (budget - given) AS is_full FROM ranked),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN capacity
    ELSE (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (), 0)) * w
      / (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)) END AS target FROM filled),
summed AS (
  SELECT hashed.doc_id, hashed.size, goals.source_size, goals.target,
    CAST(sum(size) OVER (PARTITION BY hashed.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(size AS DOUBLE) AS words,
    least(target, source_size) AS first, greatest(target - source_size, 0) AS second
  FROM hashed JOIN goals ON hashed.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, CAST({takes("first")} + {takes("second")} AS BIGINT) AS taken FROM summed
"""


def op5_licenses() -> str:
    phrases = ", ".join(f"({listed(p.split())}, {quoted(label)})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({listed(licenses.words_of(t))}, {len(re.findall('[0-9a-z]+', t.lower()))}, {quoted(name)})" for name, t in licenses.TEMPLATES.items())
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, lower(coalesce(text, '')) AS t FROM documents),
worded AS (SELECT id, doc_id, t, list_filter(string_split(regexp_replace(t, '{gap}', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM texts),
phrases(phrase, label) AS (VALUES {phrases}),
templates(words, total, template) AS (VALUES {templates}),
starts AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
places AS (SELECT id, i - 1 AS place, label FROM starts JOIN phrases ON words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase),
base AS (
  SELECT id, count(*) AS n, min(place) AS lowest, max(place) AS highest, list(DISTINCT label) AS labels FROM places GROUP BY id),
split AS (SELECT id, words, string_split(t, chr(10)) AS lines FROM worded),
numbered AS (SELECT id, words, lines, unnest(range(1, len(lines) + 1)) AS n FROM split),
counted AS (
  SELECT id, words, n, len(list_filter(string_split(regexp_replace(lines[n], '{gap}', ' ', 'g'), ' '), lambda x: x <> '')) AS n_words FROM numbered),
spans AS (
  SELECT id, words, sum(n_words) OVER (PARTITION BY id ORDER BY n) - n_words AS first, sum(n_words) OVER (PARTITION BY id ORDER BY n) AS past
  FROM counted WHERE n_words > 0),
starting AS (SELECT id, spans.words, first, past + total AS reach, template, templates.words AS wanted FROM spans CROSS JOIN templates),
shares AS (
  SELECT s.id, template, len(list_intersect(list_distinct(s.words[s.first + 1 : spans.past]), wanted)) AS overlap, len(wanted) AS size
  FROM starting AS s ASOF JOIN spans ON s.id = spans.id AND s.reach >= spans.first),
found AS (
  SELECT id, list(DISTINCT template) AS labels, max(overlap / size) AS containment FROM shares
  WHERE overlap >= ceil(size * {licenses.CONTAINMENT} - 1e-9) GROUP BY id)
SELECT doc_id, CAST(len(worded.words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lowest AS first_word, highest AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (id) LEFT JOIN found USING (id)
"""


def op6_quality_rules() -> str:
    def condition(rule: rules.Rule) -> str:
        holds = " AND ".join(
            f"{rule.metric} {sign} {bound}" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None
        )
        return f"(n_words < {rule.min_words} OR ({holds}))" if rule.min_words else f"({holds})"

    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
starts AS (SELECT id, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) AS i FROM texts),
repeats AS (SELECT id, i, count(*) OVER (PARTITION BY id, words[i : i + {rules.WINDOW - 1}]) AS n FROM starts),
covered AS (
  SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + {rules.WINDOW})) AS j FROM repeats WHERE n > 1) GROUP BY id),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) AS exclamations, len(lines) AS n_lines,
    len(list_filter(words, lambda x: list_contains({listed(rules.STOP_WORDS)}, x))) AS stops
  FROM lined LEFT JOIN covered USING (id)),
ratios AS (
  SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbol_ratio,
    {ratio("exclamations", "n_words")} AS exclamation_ratio, {ratio("stops", "n_words")} AS stop_word_ratio,
    {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, {ratio("n_words", "n_lines")} AS mean_line_words,
    n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(condition, rules.RULES))} AS kept FROM ratios
"""


def op7_substring_dedup() -> str:
    size = superkmers.WINDOW
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM texts),
windows AS (SELECT id, i, md5(array_to_string(words[i : i + {size - 1}], ' ')) AS w FROM starts),
repeats AS (SELECT id, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
covered AS (SELECT DISTINCT id, unnest(range(i, i + {size})) AS j FROM repeats),
placed AS (SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM texts),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM placed ANTI JOIN covered USING (id, j) GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (id)
"""


def op10_embeddings() -> str:
    return f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {embeddings.COSINE}),
reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def op11_prefix_trie() -> str:
    # Bit by bit, over the digits of the id.
    shifted = "xor(x >> 1, 3988292384 * (x & 1))"
    digits = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    by_byte = f"lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {shifted})"
    crc32 = f"xor(list_reduce(list_concat([4294967295], {digits}), {by_byte}), 4294967295)"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, {WORDS} AS words FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % {prefix_trie.BLOCK} AS block, {crc32} % {prefix_trie.HEADS} AS h FROM placed WHERE place = 1),
joined AS (
  SELECT convs.conv_id, 0 AS own, place, role, text, len(words) AS words FROM convs JOIN placed ON placed.conv_id = block WHERE place <= h
  UNION ALL SELECT conv_id, 1, place, role, text, len(words) FROM convs JOIN placed USING (conv_id) WHERE place > h),
prefixes AS (
  SELECT conv_id, words, row_number() OVER path AS depth, string_agg(md5(role) || md5(text), '') OVER path AS key FROM joined
  WINDOW path AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)),
rows AS (SELECT * FROM prefixes UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM rows GROUP BY conv_id),
ends AS (
  SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM rows JOIN lengths USING (conv_id, depth) GROUP BY key),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM rows GROUP BY key, depth),
children AS (SELECT substr(key, 1, length(key) - 64) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM rows a JOIN rows b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
totals AS (
  SELECT top AS key, count(*) FILTER (children.n IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM below JOIN nodes USING (key) LEFT JOIN children USING (key) GROUP BY top)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, parents.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n, 0) AS n_children,
  n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN totals USING (key) LEFT JOIN children USING (key) LEFT JOIN ends USING (key)
LEFT JOIN nodes parents ON nodes.depth > 0 AND parents.key = substr(nodes.key, 1, length(nodes.key) - 64)
"""


STATEMENTS = {
    f.__name__: f()
    for f in (op1_mixing, op5_licenses, op6_quality_rules, op7_substring_dedup, op10_embeddings, op11_prefix_trie)
}
