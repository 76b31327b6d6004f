"""The patterns by which logs of test runners and runtimes are known and read."""

from __future__ import annotations

import re

# The patterns by which logs are recognised and read.
ERROR_LINE = r"(?P<type>(?:[A-Za-z_][A-Za-z0-9_]*)?(?:Error|Exception))"
PATTERNS = {
    "pytest": r"(?i:pytest)|= short test summary info =|FAILED\s+[\w/\.\-]+::\w+|E\s+(?:[A-Za-z_][A-Za-z0-9_]*)?(?:Error|Exception|assert):|_{5,}\s*test_\w+\s*_{5,}",
    "pytest_summary": rf"FAILED\s+(?P<file>[^\s:]+)(?:::(?P<func>[^\s\-]+))?\s+-\s+(?:(?P<type>(?:[A-Za-z_][A-Za-z0-9_]*)?(?:Error|Exception)):\s*(?P<message>.*)|assert\s+(?P<claim>.*)|(?P<other>.*))",
    "pytest_error": rf"^E\s+{ERROR_LINE}:\s*(?P<message>.*)",
    "pytest_assert": r"^E\s+(?P<claim>assert\s+.*)",
    "pytest_frame": r"^(?P<file>(?:[a-zA-Z]:)?[a-zA-Z0-9_\-/\.\\]+\.[a-zA-Z0-9_]+):(?P<line>\d+):\s+(?:in\s+(?P<func>[^\n]+)|(?P<raised>[A-Za-z_][A-Za-z0-9_]*Error.*))",
    "quoted_frame": r'File\s+"(?P<file>[^"]+)",\s*line\s*(?P<line>\d+)(?:,\s*in\s+(?P<func>.+))?',
    "unittest": r"^(?:FAIL|ERROR):\s+(?P<name>[^\s\(]+)\s*(?:\((?P<case>[^\)]+)\))?",
    "unittest_summary": r"\A(?s:(?=.*Ran )(?=.*FAILED \((?:failures|errors)=))",
    "traceback": r"Traceback \(most recent call last\):|(?:SyntaxError|IndentationError):\s*.*",
    "traceback_frame": r'^\s*File\s+"(?P<file>[^"]+)",\s*line\s*(?P<line>\d+)(?:,\s*in\s+(?P<func>[^\n]+))?(?:\n[ \t]+(?!\s*File\s+)(?![A-Za-z_][\w\.]*(?:Error|Exception|Exit|Interrupt):)(?P<code>.+))?',
    "traceback_error": r"^(?P<type>(?:[A-Za-z_][A-Za-z0-9_\.]*)?(?:Error|Exception|Exit|Interrupt|Warning))(?::\s*(?P<message>.*))?$",
    "traceback_loose": r"(?P<type>(?:[A-Za-z_][A-Za-z0-9_]*)?Error)(?::\s*(?P<message>.*))?",
    "chain": r"\n\s*(?:During handling of the above exception, another exception occurred:|The above exception was the direct cause of the following exception:)\s*\n",
    "jest": r"FAIL |expect\(received\)\.|●\s+.*\s*›\s*",
    "jest_expect": r"expect\(received\)\.",
    "jest_values": r"Expected:\s*(?P<expected>[^\n]+)\s*\n\s*Received:\s*(?P<received>[^\n]+)",
    "jest_file": r"FAIL\s+(?P<file>[^\s\n]+\.[jt]sx?)",
    "at_frame": r"^\s*at\s+(?:(?P<func>[^\(\s]+)\s+\()?(?P<file>(?:[a-zA-Z]:)?[^:\(\)\n]+):(?P<line>\d+):(?P<col>\d+)\)?",
    "named_error": rf"{ERROR_LINE}:\s*(?P<message>[^\n]+)",
    "node_error": rf"^{ERROR_LINE}:\s*(?P<message>.*)",
    "go_test": r"---\s+FAIL:\s+(?P<name>[^\s]+)\s+\([^\)]+\)",
    "go_test_line": r"^\s*(?P<file>(?:[a-zA-Z]:)?[a-zA-Z0-9_\-/\.\\]+\.go):(?P<line>\d+):\s+(?P<message>.*)",
    "go_panic": r"^panic:\s*(?:runtime error:\s*)?(?P<message>.*)",
    "go_frame": r"^\s*(?P<func>[a-zA-Z0-9_\-\.\/]+\.[a-zA-Z0-9_]+)\(.*\)\n\s+(?P<file>(?:[a-zA-Z]:)?[^\n:]+):(?P<line>\d+)(?:\s+\+0x[0-9a-f]+)?",
    "rust_panic": r"thread\s+'[^']+'\s+panicked\s+at\s+'(?P<message>[^']+)',\s*(?P<file>(?:[a-zA-Z]:)?[^:]+):(?P<line>\d+):(?P<col>\d+)",
    "rust_frame": r"^\s*\d+:\s+(?P<func>[^\n]+)\n\s+at\s+(?P<file>(?:[a-zA-Z]:)?[^:]+):(?P<line>\d+):(?P<col>\d+)",
    "generic": r"(?i)(?:^|\n)(?:FATAL|ERROR|Exception|Error|panic|FAIL)[\s:]+(?P<message>[^\n]+)",
    "last_line": r"^[^\S\n]*+\S[^\n]*+\s*+\Z",
    "generic_type": r"(?P<type>(?:[A-Za-z_][A-Za-z0-9_]*)?(?:Error|Exception|Panic))",
    "generic_file": r"(?P<file>(?:[a-zA-Z]:)?[a-zA-Z0-9_\-/\.\\]+\.[a-zA-Z0-9_]+)[:\(](?P<line>\d+)[\):]?",
}
_MULTILINE = {"pytest_error", "pytest_assert", "pytest_frame", "unittest", "traceback_frame", "traceback_error", "at_frame", "node_error", "go_test_line", "go_panic", "go_frame", "rust_frame", "last_line"}
RE = {k: re.compile(v, re.M if k in _MULTILINE else 0) for k, v in PATTERNS.items()}

#: The patterns of which one must be in the log of a runner; the first runner that is known counts.
KNOWN = [("pytest", ["pytest"]), ("unittest", ["unittest", "unittest_summary"]), ("jest", ["jest"]), ("go_test", ["go_test"]), ("go", ["go_panic"]), ("rust", ["rust_panic"]), ("python", ["traceback"]), ("node", ["node_error"])]
#: A pattern that must be there as well.
ALSO = {"node": "at_frame"}


def java(name: str) -> str:
    """The pattern for Spark's expressions."""
    return ("(?m)" if name in _MULTILINE else "") + PATTERNS[name].replace("(?P<", "(?<")
