"""Report wording and other fixed texts."""

# Evidence envelope.
EVIDENCE_SCHEMA = "fieldscope.evidence.v1"
TICKET_PREFIX = "FSCOPE"
PRODUCER = "fieldscope"

# Report kind -> label, and the label of any other kind.
KIND_LABELS = {
    "run_result": "Run Result",
    "object_snapshot": "Object Snapshot",
    "object_node": "Object Node",
    "event_log": "Event Log",
    "function_trace": "Function Trace",
    "error_log": "Error Report",
    "performance_snapshot": "Performance Snapshot",
    "performance_health": "Performance Snapshot",
    "performance_capture": "Performance Snapshot",
    "performance_benchmark": "Performance Snapshot",
    "performance_storage": "Performance Snapshot",
}
UNKNOWN_KIND = "Other Data"

# Error report lines.
ERROR_TITLE = "Lua Error Report"
ERROR_CONTEXT = "Context"
ERROR_TIME = "Time: %s"
ERROR_SOURCE = "Source: %s"
ERROR_COUNT = "Occurrences: %d"
ERROR_SESSION = "Capture session: %d"
ERROR_ENVIRONMENT = "Client Environment"
ERROR_VERSION = "Version: %s"
ERROR_BUILD = "Build: %s (%s)"
ERROR_LOCALE = "Locale: %s"
ERROR_ERROR = "Error"
ERROR_STACK = "Stack Trace"
ERROR_LOCALS = "Locals"
NOT_AVAILABLE = "Not available"
UNKNOWN_TIME = "Unknown time"

# Event and call details.
EVENT_DETAIL = "Event: %s"
CALL_DETAIL = "Function: %s"
ELAPSED_DETAIL = "Elapsed: +%s seconds"
NO_PAYLOAD = "This event has no payload."
NO_ARGUMENTS = "No arguments"

# Truncation markers and byte limits.
CUT_TEXT = "\n... <truncated>"
CUT_OUTPUT = "\n... <output truncated>"
CODE_BYTES = 12000
RESULT_BYTES = 48000
REPORT_BYTES = 48000
EVENT_ARGUMENT_BYTES = 256
CALL_ARGUMENT_BYTES = 180
PREVIEW_BYTES = 120
NODE_VALUE_BYTES = 512
OUTPUT_BYTES = 44000
STORE_BYTES = 16 * 1024 * 1024
STORE_RECORDS = 200
HISTORY_BYTES = 16 * 1024 * 1024
HISTORY_ENTRY_BYTES = 16 * 1024

# Own wording: what stands in for nodes that no root leads to.
CYCLE = "<cycle>"
