"""The event log's envelope and vocabulary.

The names of the envelope's attributes and of some keys are a choice of this library; both are kept in one place so
that they can be changed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Envelope of one log line. value is text; a JSON object in it stays text.
ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("task_id", T.LongType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("invoc_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
FIELDS = ENTRY.fieldNames()

# Keys of entries: fixed values of the log format.
#: Engine events: "<name of the engine>-event"; this one is written, any is read.
EVENT = "engine-event"
EVENT_PATTERN = "^[a-z]+-event$"
WF_NAME = "wf-name"
WF_TIME = "wf-time"
WF_OUTPUT = "wf-output"
HOST = "invoc-host"
TIME = "invoc-time"
TIME_SCHED = "invoc-time-sched"
TIME_STAGE_IN = "invoc-time-stagein"
TIME_STAGE_OUT = "invoc-time-stageout"
FILE_TIME_IN = "file-time-stagein"
FILE_TIME_OUT = "file-time-stageout"
FILE_SIZE_IN = "file-size-stagein"
FILE_SIZE_OUT = "file-size-stageout"
EXEC = "invoc-exec"
SCRIPT = "invoc-script"
OUTPUT = "invoc-output"
STDOUT = "invoc-stdout"
STDERR = "invoc-stderr"
USER = "invoc-user"
# Types of engine events: fixed values of the log format.
REQUESTED = "container-requested"
ALLOCATED = "container-allocated"
COMPLETED = "container-completed"


def is_event(key: str = "key") -> Column:
    return F.col(key).rlike(EVENT_PATTERN)
