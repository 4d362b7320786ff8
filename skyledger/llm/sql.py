"""DuckDB twins of the queries that SQL can express, row by row and with plain joins."""

from __future__ import annotations

from skyledger.llm.quality_rules import RULES, STOP_WORDS, Rule

_SPACE = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _fails(rule: Rule) -> str:
    low = f"({rule.value}) < {rule.least}" if rule.least is not None else "false"
    high = f"({rule.value}) > {rule.most}" if rule.most is not None else "false"
    return f"coalesce(({low}) OR ({high}), false)"


_BASE = " OR ".join(_fails(r) for r in RULES if r.base)
_FAILED = ", ".join(f"CASE WHEN {_fails(r)} THEN '{r.name}' END" for r in RULES)

QUALITY_RULES = rf"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
part AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM doc),
place AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM part),
triple AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM place),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM triple, range(0, 3) AS t(k) WHERE times > 1 GROUP BY r),
stat AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop_words,
    len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_shouts
  FROM part LEFT JOIN again USING (r))
SELECT *, ({_BASE}) AS base_failed, concat_ws(',', {_FAILED}) AS failed, concat_ws(',', {_FAILED}) = '' AS kept FROM stat"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""WITH item AS (SELECT item_id, {_words('text')} AS words FROM benchmark),
known AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM item WHERE len(words) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS words FROM documents),
found AS (
  SELECT r, i, g.size, g.item_id
  FROM (SELECT r, i, size, array_to_string(words[i : i + size - 1], ' ') AS gram
        FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM known))) d
  JOIN known g ON g.gram = d.gram AND g.size = d.size),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

ORACLE: dict[str, str] = {"op2_quality_rules": QUALITY_RULES, "op9_decontaminate": DECONTAMINATION}
