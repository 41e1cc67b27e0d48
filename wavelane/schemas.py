"""Column layouts of the model's tables, as Spark DDL."""

from __future__ import annotations

# The task life-cycle states and the groups of them the rules refer to.
TASK_STATES = (
    "RECEIVED",
    "PENDING",
    "STARTED",
    "PROCESSING",
    "PAUSED",
    "COMPLETED",
    "TIMEOUT",
    "FAILED",
)
ELIGIBLE_STATES = ("PENDING", "PAUSED")
IN_FLIGHT_STATES = ("STARTED", "PROCESSING")
EXPIRABLE_STATES = ("PENDING", "PAUSED", "STARTED", "PROCESSING")
ORDER_POLICIES = ("FIFO", "PRIORITY", "DEADLINE")

RESOURCES = "array<struct<resource_class:string,resource_id:string>>"
RESOURCES_JSON = "array<struct<resourceClass:string,resourceId:string>>"

TASKS = f"""
    task_id string, created_at timestamp, payload string, search_dsl string,
    resources {RESOURCES}, cursor string, state string, timeout_at timestamp,
    top_resource_class string, top_resource_id string, version bigint
"""

TASK_PROGRESS = """
    task_id string, total_count bigint, success_count bigint, failed_count bigint,
    updated_at timestamp, version bigint
"""

# A wave piece that does not begin its wave says where it begins; a group in one part has no part numbers.
WAVE = "struct<colour:int,taskIds:array<string>,firstPos:bigint>"
GROUP = (
    f"struct<componentId:string,orderedTasks:array<string>,waves:array<{WAVE}>,part:bigint,parts:bigint>"
)
METRICS = """struct<totalTasks:int,connectedComponents:int,largestComponent:int,
    parallelismFactor:double,serializationRatio:double,conflictsDetected:int,
    chromaticNumber:int,waveCount:int,intraComponentParallelism:double,
    estimatedDurationMillis:bigint>"""
PLAN_JSON = f"""
    id string, generatedAt string, plannerVersion string, planningDuration string,
    orderPolicy string, groups array<{GROUP}>, metrics {METRICS},
    taskToComponent map<string,string>
"""
GROUP_MESSAGE = (
    f"componentId string, orderedTasks array<string>, waves array<{WAVE}>, part bigint, parts bigint"
)
