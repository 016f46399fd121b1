"""Fixed values of the routing, gating and accounting rules.

Everything in this module is data that results depend on: word lists, lookup
tables, weights, cut-offs and prices.  No logic lives here.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: ordered prompt rules -------------------------------------
# (route, complexity level, confidence, cost of a wrong answer, category, phrases)
# The first rule with the first contained phrase wins, so order matters.
RULES = [
    ("no_llm", 0, 0.95, "trivial", "filesystem",
     ["list files", "show directory", "project structure", "folder structure", "what files", "tree"]),
    ("no_llm", 0, 0.95, "trivial", "filesystem",
     ["file size", "line count", "how many lines", "how many files", "disk usage", "file type",
      "permissions", "file exists"]),
    ("no_llm", 0, 0.90, "trivial", "filesystem",
     ["git status", "git log", "what changed", "recent commits", "which files changed", "git diff names",
      "branch list"]),
    ("no_llm", 0, 0.85, "trivial", "filesystem",
     ["what does this import", "show imports", "show exports", "function signatures", "list functions",
      "list classes"]),
    ("local", 1, 0.90, "trivial", "docs",
     ["write docstring", "add docstrings", "document this function", "add jsdoc", "add type hints",
      "add comments"]),
    ("local", 1, 0.90, "trivial", "commit_messages",
     ["commit message", "changelog entry", "pr description", "release notes", "version bump"]),
    ("local", 1, 0.95, "trivial", "formatting",
     ["format this", "fix indentation", "sort imports", "fix whitespace", "convert tabs to spaces", "prettier"]),
    ("local", 1, 0.85, "low", "codegen",
     ["simple regex", "write a regex", "regex for", "regular expression for", "glob pattern for"]),
    ("local", 1, 0.85, "low", "refactor",
     ["rename variable", "rename function", "rename class", "find and replace"]),
    ("local", 1, 0.90, "trivial", "codegen",
     ["add return type", "create constant", "extract constant", "add export", "remove unused", "dead code"]),
    ("local", 2, 0.90, "low", "formatting",
     ["convert json to yaml", "convert yaml to json", "csv to json", "convert format", "parse this",
      "serialize", "deserialize"]),
    ("local", 2, 0.85, "trivial", "analysis",
     ["explain this function", "what does this do", "explain this code", "summarize this file",
      "what is this class for"]),
    ("local", 2, 0.80, "low", "tests",
     ["write a unit test for", "add test for", "test scaffold", "mock this", "create fixture", "test template"]),
    ("local", 2, 0.80, "low", "codegen",
     ["add error handling", "add try catch", "add validation", "add input validation", "null check"]),
    ("local", 2, 0.85, "low", "codegen",
     ["create interface", "create type", "type definition", "create enum", "create model", "create schema"]),
    ("local", 2, 0.85, "low", "codegen",
     ["add logging", "add metrics", "add monitoring", "add telemetry", "instrument"]),
    ("local", 2, 0.85, "low", "docs",
     ["readme", "documentation", "api docs", "usage example", "getting started guide"]),
    ("local", 2, 0.85, "trivial", "analysis",
     ["explain this error", "what does this regex", "what is this pattern", "how does this work"]),
    ("local", 2, 0.85, "low", "codegen",
     ["write getter", "write setter", "add accessor", "generate constructor", "create factory"]),
    ("local", 3, 0.80, "medium", "codegen",
     ["crud endpoint", "rest api endpoint", "create route", "api handler", "express route", "fastapi endpoint"]),
    ("local", 3, 0.70, "medium", "codegen",
     ["implement function", "write function", "utility function", "helper function", "create class"]),
    ("local", 3, 0.70, "medium", "refactor",
     ["simple refactor", "extract function", "extract method", "inline variable", "simplify this"]),
    ("local", 3, 0.75, "medium", "devops",
     ["dockerfile", "docker compose", "makefile", "github action", "ci config", "yaml config", "terraform"]),
    ("local", 3, 0.75, "medium", "codegen",
     ["write migration", "add middleware", "create hook", "add decorator", "write plugin"]),
    ("local", 4, 0.65, "medium", "analysis",
     ["debug this", "why is this failing", "fix this error", "why does this return", "what is wrong with"]),
    ("local", 4, 0.65, "medium", "analysis",
     ["optimize this function", "make this faster", "reduce memory usage", "improve performance of"]),
    ("local", 4, 0.70, "medium", "tests",
     ["write integration test", "end to end test", "test the full flow", "acceptance test"]),
    ("cloud_recommended", 5, 0.80, "high", "analysis",
     ["architect", "system design", "design pattern for", "how should i structure", "best approach for"]),
    ("cloud_recommended", 5, 0.90, "critical", "analysis",
     ["security audit", "vulnerability", "penetration test", "threat model", "security review"]),
    ("cloud_recommended", 5, 0.75, "high", "refactor",
     ["refactor entire", "rewrite module", "migrate from", "major refactor", "redesign"]),
    ("cloud_recommended", 5, 0.70, "high", "analysis",
     ["optimize algorithm", "performance optimization", "reduce complexity", "big-o", "time complexity"]),
    ("cloud_recommended", 5, 0.75, "high", "analysis",
     ["trace this bug", "root cause", "investigate", "race condition", "deadlock", "memory leak"]),
]

# --- fixed values: delegation levels (level -> ceiling, escalation policy) ---
LEVELS = {
    0: (-1, "none"),
    1: (2, "immediate"),
    2: (3, "standard"),
    3: (5, "tolerant"),
    4: (6, "minimal"),
    5: (6, "never"),
}
DEFAULT_LEVEL = 2

# --- fixed values: smallest model size able to do a task of a given complexity
LADDER = {0: "none", 1: "1b-3b", 2: "7b-8b", 3: "12b-32b", 4: "32b-70b", 5: "cloud-sonnet", 6: "cloud-opus"}

# --- fixed values: how familiar local models are with a language, tested in this order
LANGUAGE_FAMILIARITY = {
    "python": 0.9, "javascript": 0.85, "typescript": 0.85, "java": 0.8, "go": 0.75, "rust": 0.6,
    "cpp": 0.65, "c": 0.65, "csharp": 0.7, "ruby": 0.7, "php": 0.7, "swift": 0.55, "kotlin": 0.65,
    "sql": 0.8, "html": 0.9, "css": 0.85, "bash": 0.75, "shell": 0.75, "yaml": 0.9, "json": 0.95,
    "markdown": 0.9, "toml": 0.85,
}
FAMILIARITY_BY_EXTENSION = {
    ".py": 0.9, ".js": 0.85, ".ts": 0.85, ".go": 0.75, ".rs": 0.6, ".java": 0.8, ".rb": 0.7, ".php": 0.7,
    ".c": 0.65, ".cpp": 0.65, ".cs": 0.7,
}
DEFAULT_FAMILIARITY = 0.5

# --- fixed values: weights of the complexity score ---------------------------
SCOPE_WEIGHT = {"function": 0.1, "file": 0.3, "module": 0.6, "system": 0.9}
NOVELTY_WEIGHT = {"boilerplate": 0.0, "known_pattern": 0.1, "adaptation": 0.4, "novel": 0.8}
COST_WEIGHT = {"trivial": 0.0, "low": 0.1, "medium": 0.3, "high": 0.6, "critical": 0.9}
LEVEL_CUTOFFS = [(0.15, 1), (0.30, 2), (0.50, 3), (0.65, 4), (0.80, 5)]  # below cut-off -> level, else 6
AMBIGUOUS = (0.50, 0.65)
CONTEXT_TOKENS_PER_FILE = 500
CONTEXT_WINDOW = 32000

# --- fixed values: triage answer word -> complexity level, tested in this order
TRIAGE_LEVELS = {"trivial": 1, "simple": 2, "moderate": 3, "complex": 5, "expert": 6}

# --- fixed values: category keywords, tested in this order -------------------
CATEGORY_WORDS = {
    "codegen": ["implement", "write function", "create class", "generate code", "build", "code for"],
    "docs": ["docstring", "documentation", "readme", "jsdoc", "comment", "explain"],
    "tests": ["test", "spec", "assertion", "mock", "fixture", "coverage"],
    "refactor": ["refactor", "rename", "extract", "inline", "simplify", "restructure"],
    "analysis": ["review", "analyze", "audit", "explain", "summarize", "find bugs"],
    "commit_messages": ["commit message", "changelog", "pr description", "release notes"],
    "formatting": ["format", "lint", "indent", "sort imports", "prettier", "convert"],
    "devops": ["dockerfile", "docker", "ci", "github action", "makefile", "terraform", "deploy"],
    "vision": ["screenshot", "image", "diagram", "ui", "visual", "layout"],
}

# --- fixed values: tool inferred from a prompt, tested in this order ---------
TOOL_WORDS = [
    ("write_docs", ["docstring", "jsdoc", "comment"]),
    ("commit_msg", ["commit message"]),
    ("write_tests", ["unit test", "test stub"]),
    ("codegen", ["endpoint", "route handler", "boilerplate", "middleware"]),
    ("format_convert", ["convert", "format"]),
    ("analyze", ["summarize", "what", "bug", "potential"]),
    ("refactor", ["rename", "refactor", "async/await"]),
    ("type_annotate", ["type annotation", "type hint"]),
    ("codegen", ["regex"]),
    ("codegen", ["todo"]),
    ("write_docs", ["documentation", "api doc"]),
    ("codegen", ["config template", "feature flag"]),
]

# --- fixed values: failure signals and gate phrases --------------------------
REFUSAL_PHRASES = ["as an ai", "i cannot", "i'm not able", "i can't help", "i apologize but"]
HEDGES = ["i think", "maybe", "possibly", "not sure", "might", "perhaps", "i believe"]
MORE_HEDGES = HEDGES + ["could be", "it seems"]
MARKERS = ["TODO", "TBD", "FIXME", "PLACEHOLDER", "XXX"]
SIGNAL_ORDER = ["empty_output", "refusal", "repetition_loop", "incomplete", "wrong_language",
                "confidence_caveat", "placeholder_markers", "syntax_error"]
CRITICAL_SIGNALS = ["empty_output", "refusal", "repetition_loop"]
REPETITION_UNIT = 50
QUALITY_STATUSES = ["accepted", "retried_accepted", "escalated"]

# --- fixed values: prices and overhead ---------------------------------------
PRICE_TIERS = [("opus", 25.0), ("sonnet", 15.0), ("haiku", 5.0)]  # output price per million tokens
DEFAULT_RATE = 8.0
CALL_OVERHEAD = 80
RESULT_FACTOR = 1.3
INPUT_PRICE_DIVISOR = 5
ESCALATION_OVERHEAD = 150
PROMPT_OVERHEAD = 8800  # 6500 system prompt + 6 tool schemas of 350 + 200 framing
INPUT_PRICE = 3.0
OUTPUT_PRICE = 15.0
CHEAP_INPUT_PRICE = 0.25
CHEAP_OUTPUT_PRICE = 1.25
WORK_DAYS = 22

# --- fixed values: expected output tokens per tool and complexity level ------
BASELINES = {
    "complete": {1: 150, 2: 300, 3: 500, 4: 800, 5: 1200, 6: 2000},
    "generate_code": {1: 200, 2: 400, 3: 700, 4: 1000, 5: 1500, 6: 2500},
    "analyze_file": {1: 200, 2: 350, 3: 600, 4: 900, 5: 1300, 6: 2000},
}
FALLBACK_TOOL = "complete"

# --- fixed values: file extension -> language (case-sensitive) ---------------
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".c": "c",
    ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".md": "markdown", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml",
}

# --- fixed values: file analysis instructions --------------------------------
ANALYSIS_PROMPTS = {
    "summarize": "Provide a concise summary of what this code does, its key functions, and its purpose.",
    "find_bugs": "Review this code for bugs, potential issues, and improvements. List each issue clearly.",
    "explain": "Explain this code in detail. What does each section do? What are the key design decisions?",
    "refactor": "Suggest refactoring improvements for this code. Focus on readability, maintainability, "
                "and best practices.",
}


@dataclass(frozen=True)
class GateOptions:
    """Job options of the completion quality gate."""

    check_completeness: bool = True
    check_code_parse: bool = True
    check_scope: bool = True
    check_hedging: bool = True
    check_proportionality: bool = True
    check_repetition: bool = True
    min_length: int = 20
    max_length: int = 10000


@dataclass(frozen=True)
class ContextOptions:
    """Job options of context packing."""

    max_files: int | None = 3
    max_lines: int = 120
    budget: int = 1500
    retry_budget: int = 3000
    slice_floor: int = 100


@dataclass(frozen=True)
class LearnerOptions:
    """Guards of the success-rate learner."""

    min_records: int = 50
    min_type: int = 10
    min_cell: int = 5

# --- fixed values: texts of routing reasons and learner advice, parts of prompts ---
EXCEEDS = "exceeds ceiling ("
PATTERN_MATCHED = 'Pattern matched "'
TRIAGED = "Triage classified as Level "
SCORED = "Heuristic score "
TO_LEVEL = " → Level "
STAYS_LOCAL = " → local"
ADJUSTED = ", adjusted to "
BY_LEARNER = " by learner ("
TOO_FEW = "Insufficient data ("
TOO_FEW_OF_TYPE = 'Insufficient data for task type "'
TOO_FEW_AT_LEVEL = "Insufficient data at level "
AT_LEVEL = " at level "
SUCCESS = "% success ("
SAMPLES = " samples)"
TASK = "Task: "
FILE_CONTEXT = "File Context"
CODE_SNIPPETS = "Code Snippets"
GENERATE = "Generate "
CODE_OF = " code:\n"
SURROUNDING = "\n\nContext (surrounding code):\n"
FILE_NAMED = "\n\nFile: "

# --- fixed values: reasons for a call that gave no answer ---
NO_ANSWER = "Ollama request failed"
NO_RETRY_ANSWER = "Retry Ollama request failed"
