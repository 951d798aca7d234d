"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import inputs, oracle, queries, records

_NAMES = (
    "score_tiers score_final outcome_cost model_counts line_cost features rule_route constant_route messages_text messages_route message_roles priority_groups budget_route "
    "outcome_matrix_gaps decision_coverage duplicate_texts unsorted_ids xor_violations bad_decimals unsafe_urls rule_table targets_pivot union_splits base_plus_fetched set_difference "
    "selection_join sample_tables manifest generation_seeds latency_medians tiebreak_rank rotation repetitions determinism audit_mapping audit_mismatches attempt_numbers attempt_reasons retry_fold whole_log_numbers whole_log_fold price_median tier_status "
    "term_bins token_lists vectors linear_scores argmax_model penalised_choice lagrangian_select filled_select ridge_alpha ridge_fit ridge_pair ridge_wide safety_selection safety_validation safety_calibration learned_route hangul_markers"
).split()

QUERIES = {name: getattr(queries, name) for name in _NAMES} | inputs.QUERIES | records.QUERIES
SQL = oracle.SQL | inputs.SQL | records.SQL
