"""DuckDB SQL that computes each registered query independently."""

from __future__ import annotations

# Named pieces; each may use the ones before it.
PIECES: dict[str, str] = {
    "tasks": """tasks AS (
  SELECT (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) // 7 AS batch_id,
         o_orderkey AS task_id, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'PAUSED'
              WHEN o_orderkey % 4 = 0 THEN 'STARTED' WHEN o_orderkey % 4 = 1 THEN 'PROCESSING'
              WHEN o_orderkey % 4 = 2 THEN 'COMPLETED' ELSE 'FAILED' END AS state,
         CASE WHEN o_orderstatus = 'P' OR (o_orderstatus NOT IN ('O', 'P') AND o_orderkey % 4 < 2
                                           AND (o_orderkey // 4) % 2 = 0)
              THEN 'page:' || (o_orderkey % 5) END AS cursor,
         CASE WHEN o_orderkey % 7 <> 0
              THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS timeout_at,
         c_mktsegment AS top_resource_class, CAST(o_custkey AS VARCHAR) AS top_resource_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "fp": """fp AS (
  SELECT DISTINCT t.batch_id, t.task_id, r.resource_class, r.resource_id FROM tasks t JOIN (
    SELECT o_orderkey AS task_id, 'customer' AS resource_class, CAST(o_custkey AS VARCHAR) AS resource_id
    FROM orders UNION ALL
    SELECT l_orderkey, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem) r USING (task_id))""",
    "edges": """edges AS (
  SELECT DISTINCT a.batch_id, a.task_id AS u, b.task_id AS v
  FROM fp a JOIN fp b ON a.batch_id = b.batch_id AND a.resource_class = b.resource_class
   AND a.resource_id = b.resource_id AND a.task_id < b.task_id),
both_ways AS (SELECT batch_id, u AS task_id, v AS neighbour FROM edges
              UNION ALL SELECT batch_id, v, u FROM edges),
deg AS (SELECT t.batch_id, t.task_id, count(b.neighbour) AS degree
        FROM tasks t LEFT JOIN both_ways b USING (batch_id, task_id) GROUP BY ALL)""",
    "comp": """reach(batch_id, task_id, label) AS (
  SELECT batch_id, task_id, task_id FROM tasks
  UNION SELECT b.batch_id, b.neighbour, r.label FROM reach r
        JOIN both_ways b ON b.batch_id = r.batch_id AND b.task_id = r.task_id),
comp AS (SELECT batch_id, task_id, min(label) AS component FROM reach GROUP BY ALL)""",
    "durs": """durs AS (
  SELECT event_id, c_mktsegment AS resource_class, ts,
         CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END * CAST(floor(value * 10) AS BIGINT) AS elapsed_ms
  FROM events JOIN customer ON user_id = c_custkey),
means AS (SELECT resource_class, CAST(sum(elapsed_ms) // count(*) AS BIGINT) AS mean_ms
          FROM durs WHERE elapsed_ms >= 0 GROUP BY 1)""",
    "est": """est AS (
  SELECT batch_id, task_id, CAST(CASE WHEN top_resource_class = 'BUILDING' THEN 2000
         ELSE coalesce(mean_ms, 100) END AS BIGINT) AS estimate_ms
  FROM tasks LEFT JOIN means ON resource_class = top_resource_class)""",
    "colours": """pr AS (
  SELECT batch_id, component, task_id,
         row_number() OVER (PARTITION BY batch_id, component
                            ORDER BY estimate_ms DESC, degree DESC, task_id) AS k
  FROM comp JOIN est USING (batch_id, task_id) JOIN deg USING (batch_id, task_id)),
nb AS (
  SELECT a.batch_id, a.component, a.k, list(b.k) AS ns FROM both_ways e
  JOIN pr a ON a.batch_id = e.batch_id AND a.task_id = e.task_id
  JOIN pr b ON b.batch_id = e.batch_id AND b.task_id = e.neighbour
  WHERE b.k < a.k GROUP BY ALL),
greedy(batch_id, component, k, cs) AS (
  SELECT batch_id, component, k, [0]::BIGINT[] FROM pr WHERE k = 1
  UNION ALL
  SELECT g.batch_id, g.component, p.k, list_append(g.cs, list_filter(range(0, len(g.cs) + 1),
         lambda x: NOT list_contains(list_transform(coalesce(n.ns, []::BIGINT[]), lambda i: g.cs[i]), x))[1])
  FROM greedy g JOIN pr p ON p.batch_id = g.batch_id AND p.component = g.component AND p.k = g.k + 1
  LEFT JOIN nb n ON n.batch_id = p.batch_id AND n.component = p.component AND n.k = p.k),
colours AS (SELECT p.batch_id, p.task_id, CAST(g.cs[p.k] AS INTEGER) AS colour
            FROM pr p JOIN greedy g USING (batch_id, component, k))""",
    "cev": """cev AS (
  SELECT event_id, c_mktsegment AS resource_class, ts,
         epoch_us(ts) // 60000000 AS minute,
         CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'emit' ELSE 'complete' END AS kind
  FROM events JOIN customer ON user_id = c_custkey)""",
    "emits": "emits AS (SELECT * FROM cev WHERE kind = 'emit')",
    "seeds": """seeds AS (
  SELECT top_resource_class AS resource_class, count(*) AS inflight FROM tasks
  WHERE state IN ('STARTED', 'PROCESSING') GROUP BY 1)""",
    "balance": """run AS (
  SELECT event_id, resource_class, ts, coalesce(inflight, 0) + sum(CASE kind WHEN 'emit' THEN 1 ELSE -1 END)
         OVER (PARTITION BY resource_class ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM cev LEFT JOIN seeds USING (resource_class)),
balance AS (
  SELECT event_id, resource_class, ts, CAST(s - least(0, min(s) OVER (PARTITION BY resource_class
         ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS inflight FROM run)""",
    "limits": """limits AS (
  SELECT c_mktsegment AS resource_class,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN count(*) // 6 ELSE count(*) * 50 END AS max_inflight,
         CASE WHEN c_mktsegment = 'BUILDING' THEN count(*) // 80 ELSE count(*) END AS max_rate_per_hour
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY 1)""",
    "adm": """classes AS (SELECT DISTINCT top_resource_class AS resource_class FROM tasks
            UNION SELECT DISTINCT resource_class FROM cev),
rates AS (SELECT resource_class, count(*) AS rate FROM emits
          WHERE minute > (SELECT max(minute) FROM cev) - 60 GROUP BY 1),
ends AS (SELECT resource_class, arg_max(inflight, (ts, event_id)) AS inflight FROM balance GROUP BY 1),
counted AS (
  SELECT resource_class, coalesce(inflight, 0) AS inflight, coalesce(rate, 0) AS rate,
         coalesce(max_inflight, 1000000) AS max_inflight,
         coalesce(max_rate_per_hour, 500000) AS max_rate_per_hour
  FROM classes LEFT JOIN ends USING (resource_class) LEFT JOIN rates USING (resource_class)
  LEFT JOIN limits USING (resource_class)),
adm AS (
  SELECT *, inflight < max_inflight AND rate < max_rate_per_hour AS admitted,
         greatest(inflight::DOUBLE / greatest(1, max_inflight),
                  rate::DOUBLE / greatest(1, max_rate_per_hour)) AS pressure FROM counted)""",
    "members": """members AS (
  SELECT t.*, c.component, e.estimate_ms, a.admitted, a.pressure FROM tasks t
  JOIN comp c USING (batch_id, task_id) JOIN est e USING (batch_id, task_id)
  JOIN adm a ON a.resource_class = t.top_resource_class)""",
    "sched": """sched AS (
  SELECT batch_id, component, colour, task_id, estimate_ms,
         row_number() OVER (PARTITION BY batch_id, component, colour ORDER BY
           top_resource_class, top_resource_id, pressure, created_at, task_id) AS pos,
         row_number() OVER (PARTITION BY batch_id, component ORDER BY colour,
           top_resource_class, top_resource_id, pressure, created_at, task_id) AS ordinal
  FROM members JOIN colours USING (batch_id, task_id) WHERE admitted)""",
    "ids": """ids AS (
  SELECT batch_id, component, 'component-' || (row_number() OVER (PARTITION BY batch_id ORDER BY component) - 1)
         AS component_id FROM (SELECT DISTINCT batch_id, component FROM sched))""",
    "groups": """waves AS (SELECT batch_id, component, colour, count(*) AS n, max(estimate_ms) AS ms
          FROM sched GROUP BY ALL),
groups AS (SELECT batch_id, component, sum(n) AS size, count(*) AS wave_count, max(n) AS widest,
                  CAST(max(colour) + 1 AS BIGINT) AS chi, sum(ms) AS critical_path_ms FROM waves GROUP BY ALL)""",
    "metrics": """metrics AS (
  SELECT t.batch_id, t.total_tasks, coalesce(g.n, 0) AS connected_components,
         coalesce(g.largest, 0) AS largest_component,
         coalesce(g.n::DOUBLE / greatest(1, g.largest), 0) AS parallelism_factor,
         coalesce(g.largest, 0)::DOUBLE / t.total_tasks AS serialization_ratio,
         coalesce(e.n, 0) AS conflicts_detected, coalesce(g.chi, 0) AS chromatic_number,
         coalesce(g.waves, 0) AS wave_count,
         coalesce(g.widest::DOUBLE / greatest(1, g.largest), 0) AS intra_component_parallelism,
         coalesce(g.ms, 0) AS estimated_duration_ms
  FROM (SELECT batch_id, count(*) AS total_tasks FROM tasks GROUP BY 1) t
  LEFT JOIN (SELECT batch_id, count(*) AS n FROM edges GROUP BY 1) e USING (batch_id)
  LEFT JOIN (SELECT batch_id, count(*) AS n, CAST(max(size) AS BIGINT) AS largest,
                    CAST(sum(wave_count) AS BIGINT) AS waves, max(widest) AS widest, max(chi) AS chi,
                    CAST(max(critical_path_ms) AS BIGINT) AS ms FROM groups GROUP BY 1) g USING (batch_id))""",
    "progress": """deltas AS (
  SELECT user_id AS task_id, ts,
         CASE WHEN event_type IN ('purchase', 'view') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS s,
         CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS f,
         CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS t FROM events),
progress AS (SELECT task_id, CAST(sum(t) AS BIGINT) AS total_count, CAST(sum(s) AS BIGINT) AS success_count,
                    CAST(sum(f) AS BIGINT) AS failed_count, max(ts) AS updated_at, count(*) AS version
             FROM deltas GROUP BY 1)""",
    "calls": """calls AS (
  SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN 'success'
         WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 < 2 THEN 'timeout'
         ELSE 'failure' END AS outcome FROM events)""",
    "results": """raw_out AS (
  SELECT l_orderkey AS k0, min(l_shipdate) AS started_at, CAST(sum(l_linenumber) AS BIGINT) AS pages
  FROM lineitem GROUP BY 1),
outs AS (
  SELECT CASE WHEN k0 % 97 = 0 THEN -k0 - 1 ELSE k0 END AS task_id, started_at, pages,
         started_at + to_seconds(pages * 60) AS finished_at, pages % 13 = 0 AS thrown,
         CASE WHEN pages % 5 = 0 THEN 'FAILED' WHEN pages % 5 = 1 THEN 'PAUSED' ELSE 'COMPLETED' END AS outcome
  FROM raw_out),
ruled AS (
  SELECT o.*, t.state AS was, t.cursor AS had,
         CASE WHEN t.task_id IS NULL THEN 1 WHEN t.state = 'COMPLETED' THEN 2
              WHEN t.timeout_at <= o.started_at THEN 3 WHEN thrown THEN 4
              WHEN pages * 60 > 300 AND outcome <> 'PAUSED' THEN 5
              WHEN outcome = 'COMPLETED' THEN 6 WHEN outcome = 'PAUSED' THEN 7 ELSE 8 END AS rule
  FROM outs o LEFT JOIN tasks t USING (task_id)),
results AS (
  SELECT task_id,
         CASE rule WHEN 2 THEN was WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'TIMEOUT'
              WHEN 6 THEN 'COMPLETED' WHEN 7 THEN 'PAUSED' WHEN 8 THEN 'FAILED' END AS state,
         CASE WHEN rule = 7 AND pages % 2 = 0 THEN 'page:9' WHEN rule <> 1 THEN had END AS cursor,
         rule IN (2, 6, 7) AS success,
         CASE rule WHEN 1 THEN 'Task not found' WHEN 3 THEN 'Task timed out before dispatch'
              WHEN 4 THEN 'IllegalStateException: pages=' || pages
              WHEN 5 THEN 'Task exceeded deadline (PT5M)'
              WHEN 8 THEN CASE WHEN pages % 2 = 0 THEN 'bad input' ELSE 'failed' END END AS failure_reason,
         started_at, finished_at FROM ruled)""",
    "plans": """plans AS (
  SELECT batch_id, max(created_at) AS generated_at,
         strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') || '|' || batch_id AS name FROM tasks GROUP BY 1),
plan_ids AS (
  SELECT batch_id, generated_at, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
         || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-'
         || substr(h, 21, 12) AS plan_id FROM (SELECT *, md5(name) AS h FROM plans))""",
    "failed": """failed AS (SELECT DISTINCT user_id AS task_id FROM events WHERE event_type = 'error'
           AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90)""",
    "sup": """sup AS (
  SELECT DISTINCT CAST(0 AS BIGINT) AS batch_id, l_orderkey AS task_id, 'supplier' AS resource_class,
         CAST(l_suppkey AS VARCHAR) AS resource_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "tags": """dep AS (SELECT p_partkey AS tag, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS up FROM part),
closure(tag, up) AS (
  SELECT tag, up FROM dep WHERE up IS NOT NULL
  UNION SELECT c.tag, d.up FROM closure c JOIN dep d ON d.tag = c.up WHERE d.up IS NOT NULL)""",
}

GRAPH = ["tasks", "fp", "edges"]
COMP = [*GRAPH, "comp"]
COST = ["durs", "est"]
# Part sizes that plans are nested with.
SIZES = "(VALUES (2), (10000)) AS sizes(part_tasks)"
ADM = ["cev", "emits", "seeds", "balance", "limits", "adm"]
COLOUR = [*COMP, *COST, "colours"]
SCHED = [*COLOUR, *ADM, "members", "sched"]
METRICS = [*SCHED, "groups", "metrics"]

EXPIRABLE = "('PENDING', 'PAUSED', 'STARTED', 'PROCESSING')"
NOW = "TIMESTAMP '1996-06-01'"


def _sql(pieces: list[str], body: str) -> str:
    if not pieces:
        return body
    return "WITH RECURSIVE " + ",\n".join(PIECES[p] for p in pieces) + "\n" + body


def oracle_sql() -> dict[str, str]:
    task_cols = "task_id, state, cursor, timeout_at"
    return {
        # selection and transitions
        "eligible_batch": _sql(["tasks"], """SELECT task_id, created_at, state FROM tasks
            WHERE state IN ('PENDING', 'PAUSED') ORDER BY created_at, task_id LIMIT 100"""),
        "expired_tasks": _sql(["tasks"], f"""SELECT {task_cols} FROM tasks
            WHERE state IN {EXPIRABLE} AND timeout_at <= {NOW}"""),
        "reap_timeouts": _sql(["tasks"], f"""SELECT task_id,
            CASE WHEN state IN {EXPIRABLE} AND timeout_at <= {NOW} THEN 'TIMEOUT' ELSE state END AS state,
            state IN ('STARTED', 'PROCESSING') AND coalesce(timeout_at <= {NOW}, false) AS slot_released
            FROM tasks"""),
        "orphan_recovery": _sql(["tasks"], f"""SELECT task_id, cursor,
            CASE WHEN state IN {EXPIRABLE} AND timeout_at <= {NOW} THEN 'TIMEOUT'
                 WHEN state IN ('STARTED', 'PROCESSING') THEN
                      CASE WHEN cursor IS NULL THEN 'PENDING' ELSE 'PAUSED' END
                 ELSE state END AS state FROM tasks"""),
        "inflight_tasks": _sql(["tasks"], f"""SELECT {task_cols} FROM tasks
            WHERE state IN ('STARTED', 'PROCESSING')"""),
        "tasks_by_state": _sql(["tasks"], """SELECT s.state, count(t.task_id) AS n FROM (SELECT unnest(
            ['RECEIVED', 'PENDING', 'STARTED', 'PROCESSING', 'PAUSED', 'COMPLETED', 'TIMEOUT', 'FAILED'])
            AS state) s LEFT JOIN tasks t USING (state) GROUP BY 1"""),
        "inflight_by_class": _sql(["tasks", "seeds"], "SELECT resource_class, inflight FROM seeds"),
        "inflight_work_by_class": _sql(["tasks", "progress"], """SELECT top_resource_class AS resource_class,
            CAST(sum(total_count - success_count - failed_count) AS BIGINT) AS inflight_work
            FROM tasks JOIN progress USING (task_id)
            WHERE state IN ('STARTED', 'PROCESSING', 'PAUSED') GROUP BY 1"""),
        "force_complete": _sql(["tasks"], """SELECT task_id, cursor, CASE WHEN task_id IN (
            SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'COMPLETED' ELSE state END AS state
            FROM tasks"""),
        "apply_outcomes": _sql(["tasks", "results"], """SELECT task_id, state, cursor, success,
            failure_reason FROM results"""),
        "latest_task_state": """SELECT task_id, version, state, cursor FROM (
            SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY version DESC, state DESC, cursor DESC) AS r
            FROM (SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS version,
                  CASE WHEN l_returnflag = 'R' THEN 'PAUSED' WHEN l_linestatus = 'O' THEN 'STARTED'
                       ELSE 'COMPLETED' END AS state, CAST(l_partkey AS VARCHAR) AS cursor FROM lineitem))
            WHERE r = 1""",
        "batch_assign": _sql(["tasks"], """SELECT task_id, (row_number() OVER (ORDER BY created_at, task_id) - 1)
            // 100 AS batch_no FROM tasks WHERE state IN ('PENDING', 'PAUSED')"""),
        # ingest
        "ingest_tasks": """SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
            || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-'
            || substr(h, 21, 12) AS task_id, '{}' AS payload,
            CASE WHEN toxic = 1 THEN '{"source":"' || source || '"}' ELSE '{}' END AS search_dsl,
            'PENDING' AS state, CAST(NULL AS VARCHAR) AS cursor, lang AS top_resource_class,
            CAST(quality AS VARCHAR) AS top_resource_id, CAST(0 AS BIGINT) AS version
            FROM (SELECT *, md5('doc-' || doc_id) AS h FROM documents JOIN labels USING (doc_id))
            WHERE quality IS NOT NULL""",
        "ingest_rejected": """SELECT doc_id, 'resourceId must not be blank' AS errors FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)""",
        "ingest_checks": """SELECT 'command' AS kind, CAST(doc_id AS BIGINT) AS key, array_to_string(list_filter([
              CASE WHEN doc_id % 17 = 0 OR lang IS NULL OR trim(lang) = '' THEN 'resourceClass must not be blank' END,
              CASE WHEN source IS NULL OR trim(source) = '' THEN 'resourceId must not be blank' END],
              lambda x: x IS NOT NULL), '; ') AS errors FROM documents
            WHERE doc_id % 17 = 0 OR lang IS NULL OR trim(lang) = '' OR source IS NULL OR trim(source) = ''
            UNION ALL SELECT 'delta', CAST(event_id AS BIGINT), array_to_string(list_filter([
              CASE WHEN event_id % 7 = 0 THEN 'success_delta must not be negative' END,
              CASE WHEN event_id % 5 = 0 THEN 'failed_delta must not be negative' END,
              CASE WHEN event_id % 11 = 0 THEN 'total_delta must not be negative' END], lambda x: x IS NOT NULL), '; ')
            FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0
            UNION ALL SELECT 'dry run', CAST(o_custkey AS BIGINT), 'tasks must not be empty' FROM orders
            GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'P') = 0""",
        "ingest_counter": _sql(["tasks"], """SELECT top_resource_class AS resource_class, count(*) AS n
            FROM tasks GROUP BY 1"""),
        # footprint and graph
        "footprint": _sql(["tasks"], """SELECT t.batch_id, t.task_id, 'part' AS resource_class,
            CAST(l_partkey AS VARCHAR) AS resource_id FROM tasks t JOIN lineitem ON l_orderkey = t.task_id
            UNION SELECT batch_id, task_id, top_resource_class, top_resource_id FROM tasks
            WHERE task_id NOT IN (SELECT l_orderkey FROM lineitem)"""),
        "unresolved_skipped": _sql(["tasks", *ADM, "failed"], """SELECT t.task_id, t.state FROM tasks t
            JOIN adm a ON a.resource_class = t.top_resource_class
            WHERE NOT admitted OR task_id IN (SELECT task_id FROM failed)"""),
        "footprint_range_join": _sql(["tasks", "tags"], """,
            dsl AS (SELECT *, o_custkey // 60 AS project, o_custkey // 3 AS tag_set,
                    CAST(created_at AS DATE) AS lo, CAST(created_at AS DATE) + 6 AS hi,
                    CASE WHEN task_id % 11 = 0 THEN task_id || '-1' END AS only_talk FROM tasks),
            spoken AS (SELECT task_id, l_orderkey || '-' || l_linenumber AS talk FROM dsl
                    JOIN supplier ON s_suppkey // 4 = project JOIN lineitem ON l_suppkey = s_suppkey
                     AND CAST(l_shipdate AS DATE) BETWEEN lo AND hi
                    WHERE only_talk IS NULL OR only_talk = l_orderkey || '-' || l_linenumber),
            all_tags AS (SELECT p_partkey // 4 AS tag_set, p_partkey AS tag FROM part
                    UNION SELECT p_partkey // 4, up FROM part JOIN closure ON tag = p_partkey)
            SELECT task_id, top_resource_class AS resource_class, top_resource_id AS resource_id FROM dsl
            UNION SELECT task_id, 'project', CAST(project AS VARCHAR) FROM dsl
            UNION SELECT task_id, 'connection', CAST(s_suppkey AS VARCHAR) FROM dsl
                    JOIN supplier ON s_suppkey // 4 = project
            UNION SELECT task_id, 'talk', talk FROM spoken
            UNION SELECT task_id, 'transcription', talk FROM spoken
            UNION SELECT task_id, 'tag-set', CAST(tag_set AS VARCHAR) FROM dsl
            UNION SELECT task_id, 'tag', CAST(tag AS VARCHAR) FROM dsl JOIN all_tags USING (tag_set)""").replace(
            "\n,", ",", 1),
        "dependency_closure": _sql(["tags"], """SELECT CAST(tag AS VARCHAR) AS tag_id,
            CAST(up AS VARCHAR) AS depends_on FROM closure"""),
        "conflict_edges": _sql(GRAPH, "SELECT batch_id, u, v FROM edges"),
        "edge_shared_resources": _sql(["tasks", "fp"], """SELECT a.batch_id, a.task_id AS u, b.task_id AS v,
            a.resource_class, a.resource_id FROM fp a JOIN fp b ON a.batch_id = b.batch_id
            AND a.resource_class = b.resource_class AND a.resource_id = b.resource_id
            AND a.task_id < b.task_id"""),
        "adjacency_lists": _sql(GRAPH, "SELECT batch_id, task_id, neighbour FROM both_ways"),
        "task_degree": _sql(GRAPH, "SELECT batch_id, task_id, degree FROM deg"),
        "hot_buckets": _sql(["sup"], """SELECT batch_id, resource_class, resource_id, count(*) AS bucket_size
            FROM sup GROUP BY ALL HAVING count(*) > 600"""),
        "supplier_degree": _sql(["sup"], """SELECT a.task_id, count(DISTINCT b.task_id) - 1 AS degree
            FROM sup a JOIN sup b USING (resource_id) GROUP BY 1"""),
        "supplier_components": _sql(["sup"], """,
            link AS (SELECT DISTINCT a.resource_id AS u, b.resource_id AS v FROM sup a JOIN sup b USING (task_id)),
            reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
            named AS (SELECT u, min(task_id) AS least FROM reach JOIN sup ON resource_id = v GROUP BY 1)
            SELECT task_id, min(least) AS component FROM sup JOIN named ON u = resource_id GROUP BY 1""").replace(
            "\n,", ",", 1),
        "connected_components": _sql(COMP, "SELECT batch_id, task_id, component FROM comp"),
        "component_sizes": _sql(COMP, """SELECT batch_id, component, count(*) AS component_size
            FROM comp GROUP BY ALL"""),
        "component_ids": _sql([*SCHED, "ids"], "SELECT batch_id, component, component_id FROM ids"),
        "task_to_component": _sql([*SCHED, "ids"], """SELECT batch_id, task_id, component_id
            FROM sched JOIN ids USING (batch_id, component)"""),
        "isolation_violations": _sql([*COMP], """SELECT count(*) AS violations FROM (SELECT 1
            FROM fp JOIN comp USING (batch_id, task_id) GROUP BY batch_id, resource_class, resource_id
            HAVING min(component) <> max(component))"""),
        # order
        "order_fifo": _sql(COMP, """SELECT batch_id, component, task_id, row_number() OVER (
            PARTITION BY batch_id, component ORDER BY created_at, task_id) AS policy_rank
            FROM comp JOIN tasks USING (batch_id, task_id)"""),
        "order_deadline": _sql(COMP, """SELECT batch_id, component, task_id, row_number() OVER (
            PARTITION BY batch_id, component ORDER BY timeout_at NULLS LAST, task_id) AS policy_rank
            FROM comp JOIN tasks USING (batch_id, task_id)"""),
        "order_priority": _sql(COMP, """SELECT batch_id, component, task_id, row_number() OVER (
            PARTITION BY batch_id, component ORDER BY priority NULLS LAST, created_at, task_id) AS policy_rank
            FROM comp JOIN tasks USING (batch_id, task_id)"""),
        "serial_waves": _sql(COMP, """SELECT batch_id, component, task_id, CAST(row_number() OVER (
            PARTITION BY batch_id, component ORDER BY created_at, task_id) - 1 AS INTEGER) AS colour
            FROM comp JOIN tasks USING (batch_id, task_id)"""),
        # cost
        "class_duration_mean": _sql(["durs"], "SELECT resource_class, mean_ms FROM means"),
        "running_duration_estimate": _sql(["durs"], """SELECT event_id, resource_class,
            coalesce(CAST(sum(elapsed_ms) OVER w // count(*) OVER w AS BIGINT), 100) AS estimate_ms
            FROM durs WHERE elapsed_ms >= 0 WINDOW w AS (PARTITION BY resource_class ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
        "task_estimates": _sql(["tasks", *COST], "SELECT batch_id, task_id, estimate_ms FROM est"),
        "task_duration_stats": _sql(["durs"], """SELECT resource_class, count(*) AS n,
            CAST(sum(elapsed_ms) AS BIGINT) AS sum_ms, max(elapsed_ms) AS max_ms,
            sum(elapsed_ms)::DOUBLE / count(*) AS mean_ms FROM durs GROUP BY 1"""),
        # colouring and plan
        "colour_priority": _sql([*GRAPH, *COST], """SELECT batch_id, task_id, row_number() OVER (
            PARTITION BY batch_id ORDER BY estimate_ms DESC, degree DESC, task_id) AS priority_rank
            FROM est JOIN deg USING (batch_id, task_id)"""),
        "colour_waves": _sql(COLOUR, "SELECT batch_id, task_id, colour FROM colours"),
        "colouring_violations": _sql(COLOUR, """SELECT count(*) AS violations FROM (SELECT 1
            FROM fp JOIN colours USING (batch_id, task_id) GROUP BY batch_id, resource_class, resource_id, colour
            HAVING count(*) > 1)"""),
        "wave_schedule": _sql(SCHED, """SELECT batch_id, component, colour, pos, ordinal, task_id, estimate_ms
            FROM sched"""),
        "critical_path": _sql([*SCHED, "groups"], """SELECT batch_id, component, CAST(critical_path_ms AS BIGINT)
            AS critical_path_ms FROM groups"""),
        "schedule_speedup": _sql([*SCHED, "groups"], """SELECT batch_id, component, CAST(serial_ms AS BIGINT)
            AS serial_ms, CAST(critical_path_ms AS BIGINT) AS critical_path_ms,
            serial_ms::DOUBLE / critical_path_ms AS speedup
            FROM groups JOIN (SELECT batch_id, component, sum(estimate_ms) AS serial_ms FROM sched GROUP BY ALL)
            USING (batch_id, component)"""),
        "plan_metrics": _sql(METRICS, "SELECT * FROM metrics"),
        "plan_trend": _sql(METRICS, """SELECT batch_id, parallelism_factor, chromatic_number, wave_count,
            intra_component_parallelism FROM metrics"""),
        "plan_explain": _sql(METRICS, """SELECT *, CASE WHEN total_tasks < 2 THEN 0 ELSE
            (conflicts_detected * 2)::DOUBLE / (total_tasks * (total_tasks - 1)) END AS conflict_density,
            (conflicts_detected * 2)::DOUBLE / total_tasks AS average_degree FROM metrics"""),
        "plan_nested": _sql([*SCHED, "ids"], f"""SELECT part_tasks, batch_id, component_id, part,
            (top - 1) // part_tasks + 1 AS parts, string_agg(tasks, ',' ORDER BY colour) AS ordered_tasks,
            string_agg(colour || '@' || first_pos || ':' || tasks, ';' ORDER BY colour) AS waves
            FROM (SELECT part_tasks, batch_id, component, (ordinal - 1) // part_tasks AS part, colour,
                         min(pos) AS first_pos, string_agg(task_id, ',' ORDER BY pos) AS tasks
                  FROM sched, {SIZES} GROUP BY ALL)
            JOIN (SELECT batch_id, component, max(ordinal) AS top FROM sched GROUP BY ALL) USING (batch_id, component)
            JOIN ids USING (batch_id, component) GROUP BY part_tasks, batch_id, component_id, part, top"""),
        "plan_documents": _sql([*SCHED, "ids", "plans"], f"""SELECT part_tasks, plan_id, component_id, colour, pos,
            CAST(task_id AS VARCHAR) AS task_id FROM sched JOIN ids USING (batch_id, component)
            JOIN plan_ids USING (batch_id), {SIZES}"""),
        "plan_history": _sql([*SCHED, "ids", "plans"], f""",
            newest AS (SELECT * FROM plan_ids ORDER BY generated_at DESC, plan_id DESC LIMIT 1),
            as_of AS (SELECT * FROM plan_ids WHERE generated_at <= {NOW} ORDER BY generated_at DESC, plan_id DESC LIMIT 1),
            answers AS (SELECT 'newest' AS question, * FROM newest UNION ALL SELECT 'as_of', * FROM as_of
                        UNION ALL SELECT 'by_id', * FROM plan_ids WHERE batch_id = 1400)
            SELECT question, plan_id, component_id, colour, pos, CAST(task_id AS VARCHAR) AS task_id
            FROM answers JOIN sched USING (batch_id) JOIN ids USING (batch_id, component)""").replace("\n,", ",", 1),
        "group_messages": _sql([*SCHED, "ids"], f"""SELECT part_tasks, batch_id, component_id, colour, pos,
            CAST(task_id AS VARCHAR) AS task_id FROM sched JOIN ids USING (batch_id, component), {SIZES}"""),
        "plan_diff": _sql([*SCHED], """,
            flat AS (SELECT batch_id, component, task_id, row_number() OVER (PARTITION BY batch_id, component
                     ORDER BY created_at, task_id) - 1 AS colour FROM members
                     WHERE (batch_id, component) NOT IN (
                       SELECT (batch_id, component) FROM members WHERE NOT admitted))
            SELECT coalesce(s.batch_id, f.batch_id) AS batch_id, coalesce(s.task_id, f.task_id) AS task_id,
                   s.component AS old_component, s.colour AS old_colour, f.component AS new_component,
                   CAST(f.colour AS INTEGER) AS new_colour
            FROM sched s FULL JOIN flat f ON s.batch_id = f.batch_id AND s.task_id = f.task_id
            WHERE s.colour IS DISTINCT FROM f.colour OR s.component IS DISTINCT FROM f.component""").replace(
            "\n,", ",", 1),
        "plan_json_upgrade": _sql(["tasks"], """,
            docs AS (SELECT batch_id, task_id // 10000 AS page, count(*) AS n,
                     md5(strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ')) AS h FROM tasks GROUP BY 1, 2)
            SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
              || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-'
              || substr(h, 21, 12) AS plan_id, t.batch_id, page, 'component-' || t.priority AS component_id,
              CAST(row_number() OVER (PARTITION BY t.batch_id, page, t.priority ORDER BY t.task_id) - 1
              AS INTEGER) AS colour, CAST(t.task_id AS VARCHAR) AS task_id, CAST(n AS INTEGER) AS total_tasks,
              0 AS chromatic_number FROM tasks t JOIN docs d
              ON d.batch_id = t.batch_id AND d.page = t.task_id // 10000""").replace("\n,", ",", 1),
        # admission
        "class_limits": _sql(["tasks", "limits"], """SELECT DISTINCT top_resource_class AS resource_class,
            coalesce(max_inflight, 1000000) AS max_inflight, coalesce(max_rate_per_hour, 500000)
            AS max_rate_per_hour FROM tasks LEFT JOIN limits ON resource_class = top_resource_class"""),
        "inflight_balance": _sql(["tasks", "cev", "seeds", "balance"],
            "SELECT event_id, resource_class, inflight FROM balance"),
        "hourly_rate": _sql(["cev", "emits"], """SELECT event_id, resource_class, minute,
            count(*) OVER (PARTITION BY resource_class ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
            AS n, count(*) OVER (PARTITION BY resource_class ORDER BY minute
              RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
            - count(*) OVER (PARTITION BY resource_class, minute ORDER BY ts, event_id
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_at_event FROM emits"""),
        "hourly_rate_arrival": _sql(["cev", "emits"], """SELECT event_id, resource_class, booked_minute,
            count(*) OVER (PARTITION BY resource_class ORDER BY booked_minute
              RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
            - count(*) OVER (PARTITION BY resource_class, booked_minute ORDER BY event_id
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
            FROM (SELECT event_id, resource_class, max(minute) OVER (PARTITION BY resource_class
                  ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS booked_minute FROM emits)"""),
        "class_admission": _sql(["tasks", *ADM], "SELECT * FROM adm"),
        "class_pressure": _sql(["tasks", *ADM], "SELECT resource_class, pressure FROM adm"),
        "admit_partial": _sql([*COMP, *COST, *ADM, "members"], """SELECT batch_id, component, task_id
            FROM members WHERE admitted"""),
        "admit_all_or_nothing": _sql([*COMP, *COST, *ADM, "members"], """SELECT batch_id, component, task_id
            FROM members m WHERE NOT EXISTS (SELECT 1 FROM members d WHERE NOT d.admitted
            AND d.batch_id = m.batch_id AND d.component = m.component)"""),
        "denied_by_class": _sql([*COMP, *COST, *ADM, "members"], """,
            stop AS (SELECT batch_id, component, min(task_id) AS first_denied FROM members
                     WHERE NOT admitted GROUP BY ALL)
            SELECT 'partial' AS mode, top_resource_class AS resource_class, count(*) AS denied FROM members
            WHERE NOT admitted GROUP BY ALL UNION ALL
            SELECT 'component', top_resource_class, count(*) FROM (
              SELECT DISTINCT batch_id, component, top_resource_class FROM members
              JOIN stop USING (batch_id, component) WHERE task_id <= first_denied) GROUP BY ALL""").replace(
            "\n,", ",", 1),
        "cms_estimate": _sql(["tasks", "fp"], """SELECT resource_class, resource_id, count(*) AS exact,
            true AS not_below, true AS close FROM fp GROUP BY ALL"""),
        # progress
        "progress_snapshot": _sql(["progress"], """SELECT task_id, total_count, success_count, failed_count,
            updated_at, version FROM progress"""),
        "task_status": _sql(["tasks", "progress"], """SELECT task_id, state, cursor, total_count, success_count,
            failed_count, greatest(0, total_count - success_count - failed_count) AS pending_count
            FROM tasks LEFT JOIN (SELECT * FROM progress WHERE total_count > 0) USING (task_id)"""
            ).replace("greatest(0, total_count - success_count - failed_count) AS",
                      "CASE WHEN total_count IS NOT NULL THEN greatest(0, total_count - success_count - failed_count) END AS"),
        # history
        "latest_plan": _sql(["tasks", "plans"], """SELECT plan_id, batch_id, generated_at FROM plan_ids
            ORDER BY generated_at DESC, plan_id DESC LIMIT 1"""),
        "plan_by_id": _sql(["tasks", "plans"], """SELECT plan_id, batch_id, generated_at FROM plan_ids
            WHERE batch_id = 1400"""),
        "plan_for_instant": _sql(["tasks", "plans"], f"""SELECT plan_id, batch_id, generated_at FROM plan_ids
            WHERE generated_at <= {NOW} ORDER BY generated_at DESC, plan_id DESC LIMIT 1"""),
        "plan_as_of": _sql(["tasks", "plans"], """SELECT l_orderkey, l_linenumber, l_shipdate AS ts,
            p.plan_id, p.generated_at FROM lineitem ASOF LEFT JOIN (
              SELECT generated_at, max(plan_id) AS plan_id FROM plan_ids GROUP BY 1) p
            ON l_shipdate >= p.generated_at"""),
        # operations
        "resolution_outcomes": _sql(["calls"], "SELECT outcome, count(*) AS n FROM calls GROUP BY 1"),
        "resolution_rate_5m": _sql(["calls"], """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
            outcome, count(*)::DOUBLE / 300 AS per_second FROM calls GROUP BY ALL"""),
        "build_duration_5m": """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
            sum(CAST(floor(value * 10) AS BIGINT))::DOUBLE / count(*) AS mean_ms FROM events GROUP BY 1""",
        "compile_vs_dispatch_5m": """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
            sum(ms) FILTER (c)::DOUBLE / nullif(count(*) FILTER (c), 0) AS compile_ms,
            sum(ms) FILTER (NOT c)::DOUBLE / nullif(count(*) FILTER (NOT c), 0) AS dispatch_ms
            FROM (SELECT ts, event_type IN ('view', 'click') AS c, CAST(floor(value * 10) AS BIGINT) AS ms
                  FROM events) GROUP BY 1""",
        "task_store": _sql(["tasks"], """SELECT task_id, created_at,
            CASE WHEN state = 'PENDING' THEN 'STARTED' ELSE state END AS state,
            CASE WHEN state = 'PENDING' THEN 1 ELSE 0 END::BIGINT AS version,
            CASE WHEN state = 'PENDING' THEN 'page:0' ELSE cursor END AS cursor,
            CASE WHEN task_id % 2 = 0 THEN '[{"resourceClass":"' || top_resource_class || '","resourceId":"'
              || top_resource_id || '"}]' END AS resources, least(top_resource_class, top_resource_id) AS lesser_name,
            strftime(timeout_at, '%Y-%m-%dT%H:%M:%SZ') AS timeout_text FROM tasks"""),
        "scalar_fields": _sql(["tasks"], """SELECT task_id, CAST(CAST(top_resource_id AS BIGINT) // 60 AS VARCHAR) AS project,
            (epoch_us(created_at) // 60000000) % 60 AS slot, task_id * 100 AS duration_ms,
            CASE task_id % 4 WHEN 0 THEN 'DEADLINE' WHEN 1 THEN 'PRIORITY' ELSE 'FIFO' END AS policy,
            substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
              || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-'
              || substr(h, 21, 12) AS name FROM (SELECT *, md5(CAST(task_id AS VARCHAR)) AS h FROM tasks)"""),
        "states_over_time": """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, state, count(*) AS n
            FROM (SELECT 'RECEIVED' AS state, o_orderdate AS ts FROM orders UNION ALL
                  SELECT CASE WHEN l_returnflag = 'R' THEN 'PAUSED' WHEN l_linestatus = 'O' THEN 'STARTED'
                              ELSE 'COMPLETED' END, l_shipdate FROM lineitem) GROUP BY ALL""",
        "group_results": _sql([*SCHED, "results"], """SELECT batch_id, component, bool_and(success) AS success,
            CASE WHEN bool_and(success) THEN 'success' ELSE 'failure' END AS outcome,
            date_diff('millisecond', min(started_at), max(finished_at)) AS elapsed_ms
            FROM sched JOIN results USING (task_id) GROUP BY 1, 2"""),
        "plan_duration_error": _sql([*METRICS, "results"], """SELECT batch_id, estimated_duration_ms, actual_ms,
            abs(actual_ms - estimated_duration_ms) AS abs_error_ms,
            abs(actual_ms - estimated_duration_ms)::DOUBLE / actual_ms AS relative_error
            FROM metrics JOIN (SELECT batch_id, date_diff('millisecond', min(started_at), max(finished_at))
              AS actual_ms FROM sched JOIN results USING (task_id) GROUP BY 1) USING (batch_id)"""),
        "apply_by_component": _sql(SCHED, """SELECT batch_id, component, task_id,
            CASE WHEN colour >= 2 THEN NULL WHEN estimate_ms > 1000 THEN 'PAUSED' ELSE 'COMPLETED' END AS outcome,
            CASE WHEN colour < 2 AND estimate_ms > 1000 THEN 'page:' || ordinal END AS cursor,
            CASE WHEN colour >= 2 THEN 'ValueError' END AS error_type,
            CASE WHEN colour >= 2 THEN 'wave ' || colour END AS error_message FROM sched"""),
        # streaming: the batch twin
        "stream_plan": _sql(SCHED, """SELECT batch_id, component, colour, pos, ordinal, task_id, estimate_ms
            FROM sched"""),
        "stream_progress": _sql(["progress"], """SELECT task_id, total_count, success_count, failed_count,
            updated_at, version FROM progress"""),
        "stream_inflight": _sql(["tasks", "cev", "seeds", "balance"],
            "SELECT event_id, resource_class, inflight FROM balance"),
        "stream_task_state": """SELECT task_id, max(version) AS version, arg_max(state, (version, state)) AS state
            FROM (SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS version,
                  CASE WHEN l_returnflag = 'R' THEN 'PAUSED' WHEN l_linestatus = 'O' THEN 'STARTED'
                       ELSE 'COMPLETED' END AS state FROM lineitem) GROUP BY 1""",
        "stream_rate_arrival": _sql(["cev", "emits"], """SELECT event_id, resource_class, booked_minute,
            count(*) OVER (PARTITION BY resource_class ORDER BY booked_minute
              RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
            - count(*) OVER (PARTITION BY resource_class, booked_minute ORDER BY event_id
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
            FROM (SELECT event_id, resource_class, max(minute) OVER (PARTITION BY resource_class
                  ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS booked_minute FROM emits)"""),
        "stream_hourly_rate": _sql(["cev", "emits"], """SELECT window_end, resource_class, count(*) AS n FROM (
              SELECT resource_class, unnest(range(date_trunc('minute', ts) + INTERVAL '1 minute',
                     date_trunc('minute', ts) + INTERVAL '61 minutes', INTERVAL '1 minute')) AS window_end FROM emits)
            GROUP BY ALL"""),
        "identical_replan": _sql(SCHED, """SELECT DISTINCT batch_id, true AS same,
            batch_id <> (SELECT min(batch_id) FROM sched) AS same_when_moved FROM sched"""),
        "stream_timeouts": _sql(["tasks"], f"""SELECT task_id, state AS from_state, 'TIMEOUT' AS state,
            epoch_ms(timeout_at) AS timeout_ms FROM tasks WHERE state IN {EXPIRABLE}
            AND timeout_at <= (SELECT max(created_at) FROM tasks)"""),
        "stream_group_messages": _sql([*SCHED, "ids"], """SELECT batch_id, component_id, colour, pos,
            CAST(task_id AS VARCHAR) AS task_id FROM sched JOIN ids USING (batch_id, component)"""),
    }
