"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from panelmill.llm.alignment import op12_token_alignment
from panelmill.llm.bpe import op6_bpe
from panelmill.llm.decontamination import op1_decontamination
from panelmill.llm.language_model import op7_lm_scores
from panelmill.llm.learned_index import op13_neighbours
from panelmill.llm.minhash import op10_near_dedup
from panelmill.llm.passages import op9_fuzzy_passages
from panelmill.llm.quality_classifier import op2_quality_classifier
from panelmill.llm.quality_rules import op3_quality_rules
from panelmill.llm.secrets import op5_secrets
from panelmill.llm.sharding import op8_sharding
from panelmill.llm.substring_dedup import op4_substring_removal
from panelmill.llm.vector_codes import op11_vector_codes

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_removal": op4_substring_removal,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_lm_scores": op7_lm_scores,
    "op8_sharding": op8_sharding,
    "op9_fuzzy_passages": op9_fuzzy_passages,
    "op10_near_dedup": op10_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_neighbours": op13_neighbours,
}

# Contamination has a SQL form; the other operators are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 9), ' ') AS phrase, least(len(w), 10) AS size
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
g AS (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT g.doc_id, g.k, g.size, win.item_id FROM g JOIN win USING (phrase, size)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
