"""Fixed schemas of the JSON-lines records."""

CONFIDENCE = "struct<mean_logprob: double, min_logprob: double, mean_entropy: double>"

META = f"""
 sample_id string, dataset_index bigint, dataset_index_global bigint, prompt_hash string,
 question string, answer string, difficulty string, response_off string, response_on string,
 answer_off string, answer_on string, correct_off boolean, correct_on boolean,
 truncated_off boolean, truncated_on boolean, confidence_off {CONFIDENCE},
 n_tokens_off bigint, n_tokens_on bigint, prompt_len_off bigint, prompt_len_on bigint,
 prompt_truncated boolean, has_reasoning_on boolean, unclosed_think_on boolean,
 confidence_version int, subtask string, category string
"""

LABEL = """
 sample_id string, prompt_hash string, label string, graded_label string,
 correct_off boolean, correct_on boolean, difficulty string, truncated_on boolean,
 n_tokens_on bigint, n_tokens_off bigint, truncated_off boolean, grader_version string,
 correct_off_stored boolean, correct_on_stored boolean,
 unclosed_think_on boolean, unclosed_think_off boolean
"""

SIDECAR = f"""
 sample_id string, confidence_off {CONFIDENCE}, confidence_version int,
 flags array<string>, prompt_source string, token_delta int
"""

READOUT = """
 sample_id string, task string, family string, kind string, covered boolean,
 exclude_reason string, options array<string>, gold string, n_options int,
 probs array<double>, argmax string, p_max double, entropy double, entropy_norm double,
 option_mass double, s1_correct boolean, flags array<string>
"""

MEAN = "struct<mean: double, ci: array<double>, n: int, sd: double>"
INTERVAL = "struct<ci: array<double>, n_boot: int, n_seeds: int>"

METRICS = f"""
 task string, target string, n_samples bigint, base_rate_helped double,
 aggregate struct<
   test_auroc: {MEAN}, test_auroc_bootstrap: {INTERVAL},
   test_auroc_by_difficulty: map<string, {MEAN}>,
   baseline_never_think: {MEAN}, baseline_always_think: {MEAN}, oracle: {MEAN},
   test_routed_accuracy: {MEAN}, min_routed_for_always_think_accuracy: {MEAN}>
"""

BASELINES = f"""
 target string, n bigint, base_rate double,
 baselines map<string, struct<test_auroc: {MEAN}, test_auroc_bootstrap: {INTERVAL}, val_auroc: {MEAN}>>
"""

TRANSFER = f"""
 source_task string, target_task string, target_objective string, source_test_auroc double,
 transfer_auroc {MEAN}, transfer_auroc_bootstrap {INTERVAL}, auroc_drop_pp double, verdict string,
 per_probe array<struct<seed: int, auroc_bootstrap: {INTERVAL}>>
"""

_SPLIT = """struct<sample_id: array<string>, y: array<int>, correct_off: array<boolean>,
 correct_on: array<boolean>, score: array<double>, scores: map<string, array<double>>>"""

PREDICTIONS = f"target string, source string, seeds map<string, map<string, {_SPLIT}>>"
