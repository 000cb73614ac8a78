"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op10_benchmark_decontamination
from .html_extraction import op1_html_extraction
from .order_minhash import op6_order_minhash
from .packing import op7_best_fit_packing
from .pii import op2_information_theoretic_pii
from .quality import op3_quality_classifier
from .simhash import op4_simhash_near_dedup
from .token_count import op8_token_counts
from .tool_calls import op5_tool_call_linking
from .url_filter import op9_url_filter

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_information_theoretic_pii": op2_information_theoretic_pii,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_order_minhash": op6_order_minhash,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

#: Of the ten, only linking can be written in SQL; the others need models, tokenizers or hashes that DuckDB lacks.
ORACLES: dict[str, str] = {
    "op5_tool_call_linking": """
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
l(conv_id, turn, level) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2)
SELECT u.conv_id, u.turn, concat(u.conv_id, ':', u.turn) AS call_id, 'reply' AS tool, l.level, CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status, '' AS problems, CAST(0 AS BIGINT) AS repeated,
  concat('{"arguments":{"prompt":', to_json(u.text), ',"turn":', u.turn, '},"id":"', u.conv_id, ':', u.turn, '","level":', l.level, ',"name":"reply",',
         CASE WHEN a.turn IS NULL THEN '' ELSE concat('"result":{"text":', to_json(a.text), '},') END, '"status":"', CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'ok' END, '"}') AS json
FROM u JOIN l USING (conv_id, turn) LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT a.conv_id, a.turn, concat(a.conv_id, ':', a.turn - 1), NULL, NULL, 'orphan', NULL, 0, concat('{"id":"', a.conv_id, ':', a.turn - 1, '","result":{"text":', to_json(a.text), '},"status":"orphan"}')
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
UNION ALL
SELECT conv_id, turn, NULL, NULL, NULL, 'message', NULL, 0, concat('{"content":', to_json(text), ',"role":', to_json(role), '}') FROM conversations WHERE role NOT IN ('user', 'assistant')""",
}
