"""DuckDB SQL for the queries of this package that SQL can express."""

from functools import reduce

from .license_texts import DIGESTS, TEXTS
from .licenses import BODY, NOT_WORD, OWNER_LINE, TITLE, replacements

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
       h AS text_sha256
FROM d
"""



def _canonical(text: str) -> str:
    owned = f"regexp_replace(regexp_replace(lower({text}), '{BODY}', chr(10) || '\\1', 'g'), '{OWNER_LINE}', '', 'g')"
    plain = f"'  ' || regexp_replace({owned}, '{NOT_WORD}', '  ', 'g') || '  '"
    return f"regexp_replace(trim({reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", replacements(), plain)}), '{TITLE}', '\\1')"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEXTS.items())
_LONG = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS.items())
LICENSE_SCAN = f"""
WITH every AS (SELECT sha256({_canonical("t")}) AS h, name FROM (VALUES {_KNOWN}) AS v(name, t) UNION ALL SELECT h, name FROM (VALUES {_LONG}) AS v(name, h)),
     known AS (SELECT h, min(name) AS license FROM every GROUP BY 1),
     d AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS h FROM documents)
SELECT d.doc_id, d.h AS canonical_sha256, CASE WHEN d.h <> sha256('') THEN known.license END AS license
FROM d LEFT JOIN known ON d.h = known.h
"""

PREFERENCE = r"""
WITH t AS (
  SELECT CAST(conv_id // 2 AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, role, text
  FROM conversations),
digests AS (
  SELECT pair_id, turn,
         list_sort(list(role || chr(1) || text) FILTER (side = 'chosen')) IS NOT DISTINCT FROM
         list_sort(list(role || chr(1) || text) FILTER (side = 'rejected')) AS same
  FROM t GROUP BY pair_id, turn),
firsts AS (SELECT pair_id, min(turn) FILTER (NOT same) AS first_turn FROM digests GROUP BY 1),
placed AS (
  SELECT t.pair_id, CASE WHEN first_turn IS NULL OR turn < first_turn THEN 'prompt' ELSE side END AS segment,
         turn // 64 AS chunk, turn, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body, text
  FROM t JOIN firsts USING (pair_id)
  WHERE NOT (first_turn IS NULL OR turn < first_turn) OR side = 'chosen'),
spots AS (
  SELECT *, sum(length(head) + length(body)) OVER w - length(body) AS a, sum(length(head) + length(body)) OVER w AS b,
         row_number() OVER w AS k
  FROM placed WINDOW w AS (PARTITION BY pair_id, segment, chunk ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
full_rows AS (
  SELECT pair_id, segment, chunk, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
         CASE WHEN segment = 'prompt' THEN '' ELSE coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY k) FILTER (role = 'assistant'), '') END AS loss_spans
  FROM spots GROUP BY pair_id, segment, chunk)
SELECT pair_id, segment, CAST(chunk AS BIGINT) AS chunk, CAST(n_turns AS BIGINT) AS n_turns, text, loss_spans FROM full_rows
UNION ALL
SELECT pair_id, s.side, 0, 0, '', ''
FROM firsts CROSS JOIN (VALUES ('chosen'), ('rejected')) AS s(side)
WHERE NOT EXISTS (SELECT 1 FROM full_rows f WHERE f.pair_id = firsts.pair_id AND f.segment = s.side)
"""

ORACLES = {
    "op4_license_scan": LICENSE_SCAN,
    "op9_exact_dedup": EXACT_DEDUP,
    "op10_preference_pairs": PREFERENCE,
}
