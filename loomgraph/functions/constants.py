"""Settings as data: a language, a package or a weight is added here, not in code.

Fixed values: these decide results and are stated as they are.
"""

IGNORE_DIRS = {
    ".git", "node_modules", "venv", "__pycache__", ".mypy_cache", "dist", "build", ".tox", ".pytest_cache", ".idea",
    ".vscode", "env", ".env", "site-packages", ".next", "coverage", "htmlcov", ".cache", "vendor", "bower_components",
    "jspm_packages", ".sass-cache", "target", "out", "output", "generated", ".gradle", ".mvn", "Pods", "DerivedData",
}

LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".java": "Java", ".c": "C", ".cpp": "C++", ".cc": "C++", ".cs": "C#", ".go": "Go", ".rb": "Ruby", ".php": "PHP",
    ".html": "HTML", ".css": "CSS", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown",
    ".sh": "Shell", ".bash": "Shell", ".toml": "TOML", ".xml": "XML",
}

CATEGORIES = {
    "source": [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".cc", ".cs", ".go", ".rb", ".php"],
    "config": [".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg", ".env"],
    "assets": [".html", ".css", ".md", ".txt", ".rst"],
}

MAX_FILE_BYTES = 5 * 1024 * 1024

COMPLEXITY_KEYWORDS = {
    "Python": ["if ", "elif ", "for ", "while ", "try:", "except", "with ", "yield"],
    "JavaScript": ["if (", "else if", "for (", "while (", "try {", "catch (", "switch ("],
    "TypeScript": ["if (", "else if", "for (", "while (", "try {", "catch (", "switch ("],
    "Java": ["if (", "else if", "for (", "while (", "try {", "catch (", "switch ("],
    "C": ["if (", "for (", "while (", "switch ("],
    "C++": ["if (", "for (", "while (", "switch (", "try {"],
    "default": ["if", "for", "while"],
}
COMPLEXITY_BANDS = (5, 15)

RISK_WEIGHTS = {"centrality": 0.30, "in_degree": 0.20, "errors": 0.25, "execution": 0.15, "complexity": 0.10}
RISK_BANDS = (0.25, 0.55)
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
CONSOLE_LEVELS = {"high": "ERROR", "medium": "WARNING", "low": "INFO"}

KNOWN_PACKAGES = {
    "os", "sys", "re", "ast", "json", "math", "time", "datetime", "pathlib", "collections", "itertools", "functools",
    "typing", "subprocess", "threading", "asyncio", "logging", "argparse", "hashlib", "zipfile", "tempfile", "shutil",
    "copy", "io", "dataclasses", "abc", "enum", "contextlib", "inspect",
    "numpy", "pandas", "requests", "flask", "django", "fastapi", "sqlalchemy", "pytest", "networkx", "matplotlib",
    "PIL", "scipy", "sklearn", "tensorflow", "torch", "textual", "rich", "openai", "pydantic", "uvicorn", "aiohttp",
    "httpx",
    "react", "vue", "angular", "express", "lodash", "axios", "path", "fs", "http", "https", "url", "events", "stream",
    "java", "javax", "org", "com", "sun",
}

ALWAYS_USED_FUNCTIONS = {
    "main", "__init__", "__str__", "__repr__", "__len__", "__eq__", "__hash__", "__call__", "__enter__", "__exit__",
    "__iter__", "setUp", "tearDown", "render", "get", "post", "put", "delete", "handle", "run", "start", "stop",
    "connect", "disconnect",
}

ISOLATION_LANGUAGES = ["Python", "JavaScript", "TypeScript", "Java", "C", "C++"]
EXCESSIVE_DEPENDENCIES = 10
ENTRY_STEMS = ["main", "app", "index", "server", "run", "start", "manage"]
ENTRY_FILES = ["main.py", "app.py", "run.py", "server.py", "index.py", "start.py", "manage.py", "cli.py", "__main__.py"]

INTENTS = {
    "error": r"\b(error|fail|crash|bug|broken|syntax|exception)\b",
    "risk": r"\b(risk|dangerous|unsafe|critical|important|central)\b",
    "dependency": r"\b(depend|import|require|circular|cycle|link)\b",
    "entry": r"\b(entry|start|main|run|execute|launch)\b",
    "complexity": r"\b(complex|complicated|hard|maintainab|refactor)\b",
    "unused": r"\b(unused|dead|orphan|unreachable|never called)\b",
}

CONTEXT_FILES = 8
SNIPPET_CHARS = 800
PROMPT_CHARS = 500
CHARS_PER_TOKEN = 4

#: Java's regular expressions with \\w, \\s and \\b as Unicode classes and only \\n as a line's end.
JS_IMPORTS = [
    r"""(?dU)import\s+(?:.*?\s+from\s+)?['"]([^'"]+)['"]""",
    r"""(?dU)require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""(?dU)import\s*\(\s*['"]([^'"]+)['"]\s*\)""",
]
JS_FUNCTIONS = r"(?dU)(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(|(?:async\s+)?function\s*\*?\s*(\w+)\s*\()"
JAVA_IMPORTS = r"(?dmU)^import\s+([\w.]+)\s*;"
JAVA_METHODS = r"(?dU)(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\("

#: Marks of failed model requests: kinds by parts of the error's name, and by parts of its message.
ERROR_NAMES = {"auth": ["AuthenticationError"], "rate_limit": ["RateLimitError"], "model": ["NotFoundError"], "connection": ["ConnectionError", "Timeout", "APIError"]}
ERROR_MESSAGES = {"auth": ["401"], "rate_limit": ["429"], "model": ["404", "model"], "connection": []}
