"""Row types of the job-telemetry entities."""

from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_META = T.MapType(_S, _S)

STEP = T.StructType(
    [
        T.StructField("id", _I),
        T.StructField("name", _S),
        T.StructField("image", _S),
        T.StructField("script", _S),
        T.StructField("continue_on_error", _B),
        T.StructField("metadata", _META),
        T.StructField("cpu_limit", _L),
        T.StructField("memory_limit", _S),
        T.StructField("network", _S),
        T.StructField("memory_swap", _S),
        T.StructField("pids_limit", _L),
    ]
)

JOB = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("name", _S),
        T.StructField("timestamp", _TS),
        T.StructField("metadata", _META),
        T.StructField("steps", T.ArrayType(STEP)),
        T.StructField("callback_url", _S),
        T.StructField("timeout_seconds", _L),
    ]
)

# A submission is a job plus the priority it asks for.
SUBMISSION = T.StructType([T.StructField("priority", _I), *JOB.fields])

LOG_ENTRY = T.StructType(
    [
        T.StructField("timestamp", _TS),
        T.StructField("message", _S),
        T.StructField("output_stream", _S),
    ]
)

LOG_BATCH = T.StructType(
    [
        T.StructField("job_id", _S),
        T.StructField("container_id", _S),
        T.StructField("logs", T.ArrayType(LOG_ENTRY)),
    ]
)

STATUS_EVENT = T.StructType(
    [
        T.StructField("job_id", _S),
        T.StructField("status", _S),
        T.StructField("reason", _S),
        T.StructField("ts", _TS),
        T.StructField("seq", _L),
    ]
)

# The five lifecycle states, in display order.
STATUSES = ["Queued", "Running", "Succeeded", "Failed", "Stopped"]
TERMINAL = ["Succeeded", "Failed", "Stopped"]

# Queue priorities, in consumption order.
PRIORITIES = ["high", "medium", "low"]
DEFAULT_PRIORITY = 3

# Waiting reasons that do not clear on their own.
STUCK_REASONS = [
    "ImagePullBackOff",
    "ErrImageNeverPull",
    "InvalidImageName",
    "CreateContainerConfigError",
    "CreateContainerError",
    "CrashLoopBackOff",
]

# Limits.
MAX_TIMEOUT_SECONDS = 9223372036
MAX_REASON_CHARS = 500
MAX_LOG_ENTRIES = 1000
MAX_LOG_LINES_SHOWN = 2000
MAX_LISTED_JOBS = 500
MAX_TRACKED_JOBS = 10000
MAX_BATCHES_PER_JOB = 5000
MAX_BATCHES_TOTAL = 200000
