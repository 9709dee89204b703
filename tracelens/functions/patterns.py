"""Fixed patterns, word lists and scores of the log formats and rules, in Java's dialect of regular expressions.

All values in this file are fixed by the data they describe and are stated plainly. ``U`` makes word characters and
digits Unicode, ``d`` lets only a line feed end a line, ``i`` folds case.
"""

from __future__ import annotations

LEVELS = r"DEBUG|INFO|WARNING|WARN|ERROR|EXCEPTION|CRITICAL|FATAL"

#: Log line formats in order of precedence: name, pattern, group names in order, where the level comes from.
FORMATS = [
    ("logcat_table", r"(?dU)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)-(\d+)\s+(\S+)\s+(\S+)\s+([VDIWEF])\s*(.*)", ("ts", "pid", "tid", "logger", "package", "level", "msg")),
    ("logcat", r"(?dU)^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+([^:]+):\s*(.*)", ("ts", "pid", "tid", "level", "logger", "msg")),
    ("logcat_legacy", r"(?dU)^([VDIWEF])/([^\(]+)\(\s*(\d+)\):\s*(.*)", ("level", "logger", "pid", "msg")),
    ("log4j", rf"(?diU)^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\d{{3}})\s+({LEVELS})\s+\[([^\]]+)\]\s+([\w.$:-]+)\s*-\s*(.*)", ("ts", "level", "thread", "logger", "msg")),
    ("logback", rf"(?diU)^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})\s+\[([^\]]+)\]\s+({LEVELS})\s+([\w.$:-]+)\s*-\s*(.*)", ("ts", "thread", "level", "logger", "msg")),
    ("standard", rf"(?diU)^(\d{{4}}-\d{{2}}-\d{{2}}[ T]\S+)\s+({LEVELS})\s+([\w.$:-]+)?\s*[:-]?\s*(.*)", ("ts", "level", "logger", "msg")),
    ("bracket", rf"(?diU)^({LEVELS})\s+\[([^\]]+)\]\s+(.*)", ("level", "logger", "msg")),
    ("simple", rf"(?diU)^({LEVELS})\s*[:-]\s*(.*)", ("level", "msg")),
    ("syslog", r"(?dU)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)", ("ts", "host", "logger", "pid", "msg")),
    ("key_value", r"(?diU)^(?:timestamp|time)=([^\s]+)\s+.*?(?:level)=(\S+)\s+.*?(?:message|msg)=(.+?)(?:\s+\w+=|$)", ("ts", "level", "msg")),
]
LETTER_LEVELS = {"V": "DEBUG", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}

#: What a line looks like that begins an entry, names an exception, is a stack frame, or heads a logcat table row.
ENTRY_START = rf"(?diU)^(\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}|[VDIWEF]/|\d{{4}}-\d{{2}}-\d{{2}}|{LEVELS}\b|\{{|[A-Z][a-z]{{2}}\s+\d{{1,2}}|(?:timestamp|time)=)"
EXCEPTION_LINE = r"(?dU)^[\w.]+(?:Error|Exception|Throwable)(?:\s*:.*)?$|^Traceback \(most recent call last\):"
TABLE_HEADER = r"(?dU)^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+\d+-\d+\s+\S+\s+(\S+)\s+[VDIWEF]"
PYTHON_FRAME = r"(?dU)^\s*File \"([^\"]+)\", line (\d+), in ([\w<>]+)"
PYTHON_ERROR = r"(?dU)^([\w.]+(?:Error|Exception|Warning))(?::\s*(.*))?$"

#: Event rules in order of precedence.
DURATION = r"(?diU)\b(?:duration|elapsed|cost|took|耗时)\b\s*[=:]?\s*(\d+(?:\.\d+)?)\s*(ms|s|sec|seconds|毫秒|秒)?"
EVENT_RULES = [
    ("exception", r"(?diU)\b(exception|traceback|crash|fatal)\b|异常|崩溃"),
    ("timeout", r"(?diU)\b(time[ -]?out|timed out|deadline)\b|超时"),
    ("retry", r"(?diU)\b(retry|again|attempt)\b|重试|再次"),
    ("state", r"(?diU)\b(state|status)\b|状态"),
    ("api_call", r"(?diU)\b(GET|POST|PUT|DELETE|PATCH)\b|-->|<--|/api/|http"),
    ("duration", DURATION),
    ("error", r"(?diU)\b(error|failed|failure|fail)\b|错误|失败"),
]
ERROR_LEVELS = ["ERROR", "EXCEPTION", "CRITICAL", "FATAL"]
SUSPICIOUS = ["error", "exception", "timeout", "retry"]
SESSION = r"(?diU)\b(traceId|requestId|reqId|deliveryId|orderId|taskId|sessionId|sid|uuid|sn)\b\s*[=:]\s*([A-Za-z0-9_.:-]+)"
STATES = [r"(?diU)\b(?:state|status)\b\s*[=:]\s*([A-Za-z_][\w.-]+)", r"(?diU)(?:enter|entered|进入|切换到|转到)\s*([A-Za-z_][\w.-]+)"]

#: Vocabulary: words, what is blanked before words are taken, keys and states in templates.
WORD = r"[A-Za-z一-鿿][A-Za-z0-9_一-鿿-]{2,}"
BLANKED = r"(?iU)\b\d+\b|0x[0-9a-f]+|[0-9a-f]{8,}"
TEMPLATE_BLANKED = r"(?iU)%\w|\{[^}]*\}|\b\d+\b|0x[0-9a-f]+|[0-9a-f]{8,}"
TEMPLATE_KEY = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*(?:Id|ID|_id|Trace|trace|Request|request|Order|order|Task|task|Session|session|SN|sn))\b\s*[=:]"
TEMPLATE_STATE = r"(?U)\b(?:Await|Wait|Pending|Loading|Success|Failed|Fail|Error|Timeout|Retry)[A-Za-z0-9_]*\b"
VOCABULARY_STOP = [
    "the", "and", "for", "with", "from", "this", "that", "http", "https", "post", "get", "put", "delete", "error", "failed", "failure",
    "timeout", "retry", "state", "status", "info", "debug", "warn", "warning", "null", "true", "false", "log", "logger",
]
SUGGESTION_STOP = ["error", "failed", "failure", "timeout", "retry", "state", "status", "http", "post", "get"]
REFINE_STOP = ["error", "failed", "failure", "timeout", "retry", "state", "status", "duration", "deliveryid"]
GENERIC_TOKENS = [
    "message", "msg", "send", "recv", "receive", "received", "default", "connected", "success", "failed", "error", "event", "data", "info",
    "debug", "true", "false", "请求", "响应", "消息", "成功", "失败", "状态", "事件",
]

#: Audit of templates.
AUDIT_SESSION = r"(?iU)\b(?:traceId|requestId|reqId|deliveryId|orderId|taskId|sessionId|sid|uuid|sn)\b\s*[=:]|\{[^}]*id[^}]*\}|%[sd]"
AUDIT_DURATION = r"(?iU)\b(duration|elapsed|cost|took|耗时)\b"
AUDIT_STATE = r"(?iU)\b(state|status)\b|状态|Await|Pending|Success|Failed|Timeout"
AUDIT_DETAIL = r"(?iU)\b(exception|throwable|errorCode|code|reason|cause|stack)\b|异常|原因|错误码"
LITERAL_WORD = r"[A-Za-z一-鿿]{3,}"
FORMAT_TOKEN = r"%(?:[-+ #0]*\d*(?:\.\d+)?[hljztL]*[diuoxXfFeEgGaAcspn%])|\{[^}]*\}"

#: Evidence scores.
STRUCTURED, STRUCTURED_IN_RANGE = 70.0, 20.0
LAST_FRAME, OTHER_FRAME, FRAME_IN_RANGE = 95.0, 60.0, 15.0
TEMPLATE, TEMPLATE_LEVEL, TEMPLATE_LOGGER = 85.0, 8.0, 5.0
FUZZY_BASE, FUZZY_SCALE, FUZZY_LEAST = 45.0, 35.0, 0.72
NAME_SEEN, MODULE_SEEN, NEIGHBOUR, QUERY_TERM = 25.0, 15.0, 10.0, 12.0
