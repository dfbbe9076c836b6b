"""DuckDB text of the input views, inlined as CTEs in every oracle query.

Only the base tables are registered in the oracle's DuckDB, so each oracle
statement starts with ``WITH <the views it reads> ...``.
"""

VIEW_SQL = {
    "eval_results": """
SELECT event_id,
       concat('model_', CAST(user_id % 5 AS VARCHAR)) AS model,
       CASE event_type WHEN 'click' THEN 'humaneval' WHEN 'view' THEN 'multiple-js'
            WHEN 'purchase' THEN 'multiple-java' WHEN 'signup' THEN 'multiple-cpp' ELSE 'mbpp' END AS task,
       concat('suite_', CAST(event_id % 3 AS VARCHAR)) AS suite_name,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'bigcode' ELSE 'multi_language' END AS harness,
       CASE WHEN value < 10 THEN CAST(0 AS DOUBLE) ELSE least(value / 100, CAST(1 AS DOUBLE)) END AS score,
       TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS execution_time,
       CASE event_id % 4 WHEN 0 THEN 'code_engine' WHEN 1 THEN 'role_based' WHEN 2 THEN 'deterministic' ELSE NULL END AS prompting_strategy,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 = 0 END AS is_conversational,
       ts
FROM events""",
    "eval_samples": """
SELECT concat('model_', CAST(l_suppkey % 7 AS VARCHAR)) AS model,
       l_partkey AS problem_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'instruction' WHEN 2 THEN 'conversational'
            WHEN 3 THEN 'few_shot' ELSE 'chain_of_thought' END AS template,
       CASE l_linestatus WHEN 'O' THEN 'python' ELSE 'java' END AS language,
       l_linenumber AS attempt,
       l_returnflag = 'R' AS passed,
       CASE WHEN l_returnflag = 'R' THEN 'passed' WHEN l_linenumber % 5 = 0 THEN 'timeout' WHEN l_linenumber % 5 = 1 THEN 'syntax_error'
            WHEN l_linenumber % 5 = 2 THEN 'import_error' WHEN l_linenumber % 5 = 3 THEN 'runtime_error' ELSE 'failed' END AS result,
       l_extendedprice / 1000 AS execution_time,
       l_shipdate AS ts
FROM lineitem""",
    "dated_problems": """
SELECT concat('model_', CAST(o_custkey % 5 AS VARCHAR)) AS model,
       o_orderkey AS problem_id,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS release_date,
       o_orderstatus = 'F' AS passed,
       o_totalprice / 10000 AS execution_time
FROM orders""",
    "model_cutoffs": """
SELECT * FROM (VALUES ('model_0', DATE '1999-06-30'), ('model_1', DATE '2000-01-31'), ('model_2', DATE '1996-12-31'),
                      ('model_3', DATE '2001-12-31'), ('default', DATE '1998-01-01')) AS t(model, cutoff)""",
    "feedback": """
SELECT event_id, concat('model_', CAST(user_id % 5 AS VARCHAR)) AS model, user_id AS session_user,
       CASE (event_id * 7 + user_id) % 6 WHEN 0 THEN 'code_engine' WHEN 1 THEN 'silent_generator' WHEN 2 THEN 'deterministic'
            WHEN 3 THEN 'negative_prompt' WHEN 4 THEN 'format_constraint' ELSE 'role_based' END AS strategy,
       list_value(CAST(1 AS DOUBLE), TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) / 100,
             CAST(hour(ts) AS DOUBLE) / 24, CASE WHEN event_type = 'click' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS x,
       least(value / 100, CAST(1 AS DOUBLE)) AS quality_score,
       event_type <> 'error' AS success,
       ts
FROM events""",
    "generations": """
SELECT p_partkey AS gen_id, concat('model_', CAST(p_size % 5 AS VARCHAR)) AS model, p_brand AS problem_id, p_type AS category,
       CASE p_partkey % 3 WHEN 0 THEN 'code_engine' WHEN 1 THEN 'role_based' ELSE 'negative_prompt' END AS strategy,
       CASE p_partkey % 5
         WHEN 0 THEN concat('def f_', CAST(p_size AS VARCHAR), '(n):')
         WHEN 1 THEN concat('class C', CAST(p_size AS VARCHAR), ':', chr(10), '    def __init__(self):')
         WHEN 2 THEN concat('import pandas as pd', chr(10), 'df = pd.read_csv(path)  # ', p_name)
         WHEN 3 THEN 'SELECT * FROM users WHERE'
         ELSE '' END AS prompt,
       CASE p_partkey % 7
         WHEN 0 THEN concat('Certainly! Here is the code:', chr(10), '```python', chr(10), 'def add(a, b):', chr(10), '    return a + b', chr(10), '```', chr(10), chr(10), 'This function adds ', p_name)
         WHEN 1 THEN concat('def add(a, b):', chr(10), '    return a + b')
         WHEN 2 THEN concat('I will explain the approach for ', p_name, '.')
         WHEN 3 THEN concat('function add(a, b) {', chr(10), '  return a+b;', chr(10), '}', chr(10), 'console.log(add(1, ', CAST(p_size AS VARCHAR), '));')
         WHEN 4 THEN concat('import os', chr(10), 'x = ', CAST(p_size AS VARCHAR), chr(10), 'print(eval("x"))')
         WHEN 5 THEN concat('# this sums', chr(10), 'for i in range(', CAST(p_size AS VARCHAR), '):', chr(10), '    total = total + i', chr(10), chr(10))
         ELSE '   ' END AS raw_text,
       'a + b' AS expected,
       p_partkey % 10 <> 0 AS http_success,
       p_retailprice / 1000 AS execution_time
FROM part""",
    "resource_samples": """
SELECT event_id, ts, concat('host_', CAST(user_id % 4 AS VARCHAR)) AS host,
       value % 100 AS cpu_percent, TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS memory_percent,
       value * 10 AS memory_mb
FROM events""",
    "error_log": """
SELECT event_id, ts,
       CASE user_id % 4 WHEN 0 THEN 'ollama_connection' WHEN 1 THEN 'bandit_system' WHEN 2 THEN 'system_config' ELSE 'context_analysis' END AS component,
       CASE event_id % 5 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ImportError' ELSE 'KeyError' END AS error_type,
       CASE event_id % 4 WHEN 0 THEN 'Connection refused' WHEN 1 THEN 'bandit state invalid' WHEN 2 THEN 'missing feature' ELSE 'unknown' END AS error_message
FROM events WHERE event_type = 'error'""",
    "cache_entries": """
SELECT o_orderkey AS entry_id, CASE o_orderkey % 3 WHEN 0 THEN 'humaneval' WHEN 1 THEN 'mbpp' ELSE 'multiple-js' END AS task_name,
       concat('model_', CAST(o_custkey % 5 AS VARCHAR)) AS model_name, CASE o_orderkey % 3 WHEN 2 THEN 'javascript' ELSE 'python' END AS language,
       concat('{"limit":', CAST(o_custkey % 20 AS VARCHAR), ',"verbose":true,"temperature":0.2}') AS parameters,
       o_totalprice / 200000 AS score, o_orderstatus <> 'P' AS success, o_totalprice / 10000 AS execution_time, o_orderdate AS ts, o_custkey % 9 AS access_count
FROM orders""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
