"""Schemas of the tables that the engine reads and writes, as DDL."""

MESSAGE = "struct<role:string,content:string>"
SCHEMAS = {
    "train_items": f"prompt array<{MESSAGE}>, data_source string, ability string, reward_model struct<ground_truth:string>, extra_info struct<question:string,answer:string,index:bigint,split:string>, difficulty_bin int, frozen_baseline_solve_count bigint, frozen_baseline_solve_rate double",
    "items": "id bigint, prompt string, ground_truth string, meta struct<difficulty_bin:int,frozen_baseline_solve_rate:double>",
    "arithmetic_items": "id bigint, question string, ground_truth string, meta struct<split:string,seed:bigint,steps:int,expression:string,operations:array<string>>",
    "responses": "id bigint, n int, responses array<string>, finish_reasons array<string>, output_token_counts array<int>, input_tokens int",
    "transfer_responses": "id bigint, source_id string, response string, finish_reason string, stop_reason string, output_tokens int, input_tokens int, seed bigint",
    "response_scores": "id bigint, sample int, strict_first_hash boolean, strict_last_hash boolean, frozen_lenient boolean, last_number boolean, hash_parseable boolean, marker_present boolean, extracted_first_hash string, extracted_last_hash string, extracted_last_number string, math_verify boolean",
    "score_shard": "row_id bigint, solve_count bigint, rollouts bigint, mean_response_tokens double, truncated_count bigint",
    "draws": "index bigint, stratum bigint, target_probability double, proposal_probability double, importance_weight double, draw_number bigint",
    "budget": "run string, sampled_prompts bigint, completions bigint, reward_calls bigint, optimizer_updates bigint, validation_calls bigint, generated_tokens bigint, wall_seconds double, gpu_seconds double",
    "sft": "question string, completion string",
    "population": "dataset string, state string, model string, N bigint, reader_accuracy map<string,double>, strata map<string,struct<N:bigint,n:bigint>>",
    "timing": "item_ids array<bigint>, seconds double, input_tokens bigint, output_tokens bigint, utc string",
    "train_log": "step bigint, epoch double, loss double, lr double",
    "receipts": "name string, sha256 string, bytes bigint",
}
