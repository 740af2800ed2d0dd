"""Names, words and numbers that results depend on. They are stated here as they must be, not chosen."""

from __future__ import annotations

#: Fixed values. Directories that hold no project code, besides those that start with a dot.
SKIPPED = ("__pycache__", "venv", "env", "build", "dist", "node_modules", "site-packages")

#: Fixed values. Methods of names too common to say whose they are.
COMMON_METHODS = (
    "get", "set", "add", "append", "extend", "insert", "pop", "remove", "clear", "copy",
    "update", "items", "keys", "values", "join", "split", "strip", "format", "replace",
    "read", "write", "close", "open", "run", "send", "start", "stop", "sort",
    "count", "index", "find", "encode", "decode", "lower", "upper", "startswith",
    "endswith", "match", "search", "sub", "load", "dump", "loads", "dumps",
)

#: Fixed values. Parts of parameter names that bound a recursion.
GUARDS = (
    "depth", "level", "seen", "visited", "budget", "limit", "remaining", "max_",
    "memo", "cache", "ttl", "retries", "attempt",
)

#: Fixed values. File suffixes of each language.
SUFFIXES = {
    "python": ("py",),
    "java": ("java",),
    "fortran": ("f", "for", "f77", "ftn", "fpp", "f90", "f95", "f03", "f08", "f18", "f23", "F", "FOR", "F77", "FTN", "FPP", "F90", "F95", "F03", "F08", "F18", "F23", "inc", "INC", "fi", "fh"),
    "cpp": ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++", "ipp", "tpp"),
    "c": ("c", "h"),
    "cobol": ("cbl", "cob", "cpy", "cobol", "dcl", "CBL", "COB", "CPY", "COBOL", "DCL", "Cbl", "Cpy"),
    "typescript": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"),
}

#: Fixed values. What a changed definition weighs, a step to its users, a guessed step, where chains end.
SEEDS = {"removed": 1.0, "renamed": 1.0, "signature": 0.95, "value": 0.8, "body": 0.6}
STEPS = {"calls": 0.9, "reads": 0.85}
GUESS, THRESHOLD, MAX_HOPS = 0.5, 0.1, 6

#: Fixed values. Modules that newer Python versions no longer have.
REMOVED_MODULES = (
    "imp|distutils|asyncore|asynchat|smtpd|cgi|cgitb|crypt|imghdr|pipes|"
    "telnetlib|nntplib|audioop|uu|xdrlib|msilib|nis|ossaudiodev|spwd|sndhdr|"
    "sunau|chunk|mailcap|lib2to3"
)

#: Fixed values. Old constructs: (language, id, level, pattern). All ignore case in Fortran and COBOL.
LEGACY = (
    ("python", "py-removed-module", "removed", rf"^[ \t]*(?:import|from)\s+({REMOVED_MODULES})\b"),
    ("python", "py-collections-abc", "removed", r"\bcollections\.(Mapping|MutableMapping|Sequence|MutableSequence|Set|MutableSet|Iterable|Iterator|Callable|Hashable|Sized|Container)\b"),
    ("python", "py-utcnow", "deprecated", r"\bdatetime\.utcnow\s*\(|\butcnow\s*\(\)"),
    ("c", "c-gets", "removed", r"\bgets\s*\("),
    ("c", "c-unbounded-copy", "unsafe", r"\b(strcpy|strcat|sprintf|vsprintf)\s*\("),
    ("c", "c-register", "obsolescent", r"\bregister\s+(?=\w)"),
    ("c", "c-kr-definition", "removed", r"^[A-Za-z_][\w \t\*]*?\b([A-Za-z_]\w*)\s*\(\s*[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*\s*\)[ \t]*\n(?:[ \t]*[A-Za-z_][\w \t\*\[\]]*;[ \t]*(?:/\*.*?\*/)?[ \t]*\n)+[ \t]*\{"),
    ("cpp", "cpp-prestandard-header", "removed", r"#\s*include\s*<(iostream|fstream|iomanip|strstream|stream)\.h>"),
    ("cpp", "cpp-auto-ptr", "removed", r"\bstd::auto_ptr\b|\bauto_ptr\s*<"),
    ("cpp", "cpp-dynamic-exception-spec", "removed", r"\)\s*(?:const\s*)?throw\s*\(\s*[\w:, ]+\s*\)"),
    ("cpp", "cpp-binders", "removed", r"\bstd::(bind1st|bind2nd|ptr_fun|mem_fun|mem_fun_ref)\b"),
    ("cpp", "cpp-register", "removed", r"\bregister\s+(?=\w)"),
    ("cpp", "c-gets", "removed", r"\bgets\s*\("),
    ("cpp", "c-unbounded-copy", "unsafe", r"\b(strcpy|strcat|sprintf|vsprintf)\s*\("),
    ("java", "java-boxing-constructor", "deprecated", r"\bnew\s+(Integer|Long|Short|Byte|Double|Float|Boolean|Character)\s*\("),
    ("java", "java-legacy-collection", "obsolescent", r"\bnew\s+(Vector|Hashtable|Stack)\s*[<(]"),
    ("java", "java-thread-stop", "removed", r"\.\s*(stop|suspend|resume)\s*\(\s*\)\s*;"),
    ("java", "java-finalize", "deprecated", r"\bprotected\s+void\s+finalize\s*\(\s*\)"),
    ("typescript", "js-new-buffer", "deprecated", r"\bnew\s+Buffer\s*\("),
    ("typescript", "js-arguments-callee", "removed", r"\barguments\.callee\b"),
    ("typescript", "js-escape", "deprecated", r"(?<![\w.])(escape|unescape)\s*\("),
    ("fortran", "f-arithmetic-if", "obsolescent", r"^[ \t]*(?:\d+[ \t]+)?if\s*\(.*\)\s*\d+\s*,\s*\d+\s*,\s*\d+\s*$"),
    ("fortran", "f-computed-goto", "obsolescent", r"^[ \t]*(?:\d+[ \t]+)?go\s*to\s*\(\s*\d+(?:\s*,\s*\d+)*\s*\)"),
    ("fortran", "f-assign", "removed", r"^[ \t]*(?:\d+[ \t]+)?assign\s+\d+\s+to\s+\w+"),
    ("fortran", "f-pause", "removed", r"^[ \t]*(?:\d+[ \t]+)?pause\b"),
    ("fortran", "f-common", "obsolescent", r"^[ \t]*(?:\d+[ \t]+)?common\s*/"),
    ("fortran", "f-equivalence", "obsolescent", r"^[ \t]*(?:\d+[ \t]+)?equivalence\s*\("),
    ("fortran", "f-entry", "obsolescent", r"^[ \t]*(?:\d+[ \t]+)?entry\s+\w+"),
    ("fortran", "f-block-data", "obsolescent", r"^[ \t]*block\s*data\b"),
    ("fortran", "f-forall", "obsolescent", r"^[ \t]*(?:\w+[ \t]*:[ \t]*)?forall\s*\("),
    ("cobol", "cobol-alter", "removed", r"\bALTER\s+[\w-]+\s+TO\b"),
    ("cobol", "cobol-go-to-depending", "obsolescent", r"\bGO\s+TO\b[\w\s-]*\bDEPENDING\s+ON\b"),
    ("cobol", "cobol-next-sentence", "obsolescent", r"\bNEXT\s+SENTENCE\b"),
    ("cobol", "cobol-perform-thru", "obsolescent", r"\bPERFORM\s+[\w-]+\s+(?:THRU|THROUGH)\s+[\w-]+"),
    ("cobol", "cobol-removed-verb", "removed", r"\b(EXAMINE|TRANSFORM|EXHIBIT|READY\s+TRACE|RESET\s+TRACE)\b"),
    ("cobol", "cobol-go-to", "obsolescent", r"\bGO\s+TO\s+[\w-]+\s*\."),
)

#: Fixed values. What each level of an old construct weighs.
URGENCY = {"removed": 4, "unsafe": 3, "deprecated": 2, "obsolescent": 1}

#: Fixed values. How much a change travels along an edge of each kind, and against it.
EDGE_WEIGHTS = (
    ("contains", 0.30, 0.12), ("param_of", 0.55, 0.70), ("imports", 0.08, 0.55), ("binds", 0.20, 0.90), ("reexports", 0.15, 0.80), ("inherits", 0.12, 0.95), ("overrides", 0.50, 0.85),
    ("annotates", 0.10, 0.65), ("calls", 0.22, 0.90), ("instantiates", 0.20, 0.90), ("decorates", 0.85, 0.15), ("raises", 0.35, 0.45), ("handles", 0.25, 0.50), ("reads", 0.06, 0.85),
    ("writes", 0.80, 0.45), ("mutates", 0.88, 0.50), ("assigns_from", 0.30, 0.85), ("acquires", 0.45, 0.70), ("releases", 0.45, 0.60),
)

#: Fixed values. Modules whose distribution has another name (names of modules in lower case).
OTHER_NAMES = {
    "pil": "pillow", "yaml": "pyyaml", "sklearn": "scikit-learn", "cv2": "opencv-python",
    "bs4": "beautifulsoup4", "dateutil": "python-dateutil", "dotenv": "python-dotenv",
    "jwt": "pyjwt", "openssl": "pyopenssl", "attr": "attrs", "git": "gitpython",
    "serial": "pyserial", "crypto": "pycryptodome", "magic": "python-magic",
    "mysqldb": "mysqlclient", "psycopg2": "psycopg2-binary", "skimage": "scikit-image",
    "docx": "python-docx", "zmq": "pyzmq", "usb": "pyusb", "gi": "pygobject",
    "ruamel": "ruamel-yaml", "socks": "pysocks", "faiss": "faiss-cpu",
    "google": "google-api-python-client", "multipart": "python-multipart",
    "jose": "python-jose", "slugify": "python-slugify", "telegram": "python-telegram-bot",
    "pkg_resources": "setuptools",
}

#: Fixed values. Names too vague to look for alone in a test.
VAGUE = COMMON_METHODS + (
    "main", "init", "setup", "process", "handle", "test", "value", "data",
    "name", "result", "item", "call", "apply", "execute", "build", "make",
    "new", "reset", "next", "save", "check", "parse", "render", "create",
)

_NOT_LITERAL = r"\(\s*(?:(?![\s\"'`)])|[rbuf]*[\"'][^\"'\n]*[\"']\s*(?:\+|%|\.format\b)|f[\"']|`)"
_POINTER_CALL = r"(?:^|[=;{}(),!&|?:+\-]|\breturn)\s*\(\s*\*\s*\w+(?:\[[^\]]*\])?\s*\)\s*\("

#: Fixed values. Calls that no reader can follow: (language, id, level, pattern), the level being the same for all.
HIDDEN_CALLS = (
    ("python", "py-import-by-name", "hidden", r"\b(?:importlib\.)?import_module" + _NOT_LITERAL + r"|\b__import__" + _NOT_LITERAL),
    ("python", "py-load-source", "hidden", r"\bimp\.load_(?:source|module|compiled)\s*\(|\bspec_from_file_location\s*\("),
    ("python", "py-getattr-call", "hidden", r"\bgetattr\s*\([^,()]+,\s*(?![\s\"'])[^()]*?(?:\([^()]*\))?[^()]*\)\s*\("),
    ("python", "py-eval", "hidden", r"(?<![.\w])(?<!def )(?:eval|exec)\s*\("),
    ("python", "py-entry-points", "hidden", r"\bentry_points\s*\(|\biter_entry_points\s*\("),
    ("typescript", "js-require-by-name", "hidden", r"\brequire" + _NOT_LITERAL),
    ("typescript", "js-import-by-name", "hidden", r"(?<![.\w])import" + _NOT_LITERAL),
    ("typescript", "js-eval", "hidden", r"(?<![.\w])(?:eval|Function)\s*\("),
    ("typescript", "js-index-call", "hidden", r"\b\w+\[(?![\"'`\d])[^\]]+\]\s*\("),
    ("java", "java-for-name", "hidden", r"\bClass\.forName\s*\(|\.loadClass\s*\("),
    ("java", "java-reflect-invoke", "hidden", r"\.getMethod\s*\(|\.getDeclaredMethod\s*\(|\.invoke\s*\("),
    ("java", "java-service-loader", "hidden", r"\bServiceLoader\.load\s*\("),
    ("c", "c-dlsym", "hidden", r"\b(?:dlsym|GetProcAddress)\s*\("),
    ("c", "c-fn-pointer-call", "hidden", _POINTER_CALL + r"|\b\w+\s*->\s*\w+\s*\("),
    ("cpp", "c-dlsym", "hidden", r"\b(?:dlsym|GetProcAddress)\s*\("),
    ("cpp", "c-fn-pointer-call", "hidden", _POINTER_CALL),
    ("fortran", "f-procedure-pointer", "hidden", r"\bprocedure\s*\([^)]*\)\s*,\s*pointer\b"),
    ("fortran", "f-external-dummy", "hidden", r"^\s*external\s+\w+"),
    ("cobol", "cobol-call-by-name", "hidden", r"(?<![\w-])CALL\s+(?![\"'])[A-Z][\w-]*"),
    ("cobol", "cobol-cics-link", "hidden", r"\bEXEC\s+CICS\s+(?:LINK|XCTL)\b"),
)

#: Fixed values. What parts of a name say of a layer, in the order in which they are asked.
LAYER_NAMES = (
    (("test", "tests", "conftest"), "test"),
    (("main", "__main__", "cli", "app", "entry", "manage", "run", "worker", "daemon"), "entrypoint"),
    (("api", "routes", "router", "views", "handlers", "endpoints", "controllers", "rpc", "serializers"), "interface"),
    (("service", "services", "usecase", "usecases", "workflow", "orchestrator", "pipeline", "coordinator", "manager"), "orchestration"),
    (("repository", "repositories", "dao", "db", "database", "store", "storage", "client", "gateway", "adapter", "queries", "models"), "data_access"),
    (("cache", "registry", "pool", "session", "state"), "state"),
    (("config", "settings", "constants", "conf", "env", "flags"), "config"),
    (("util", "utils", "helpers", "common", "shared", "lib", "tools", "misc"), "util"),
    (("domain", "core", "logic", "rules", "model", "entities"), "domain"),
)

#: Fixed values. Modules whose import says what a module does, and decorators of what others call.
STORE_MODULES = ("sqlite3", "sqlalchemy", "psycopg", "psycopg2", "pymysql", "asyncpg", "redis", "pymongo", "boto3", "requests", "httpx", "urllib", "urllib3", "aiohttp", "kafka", "pika", "elasticsearch", "grpc")
OUTSIDE_MODULES = ("subprocess", "socket", "shutil", "mmap", "ctypes", "select", "fcntl", "signal")
CONFIG_MODULES = ("configparser", "dotenv", "tomllib", "argparse")
CALLED_BY_OTHERS = ("route", "get", "post", "put", "patch", "delete", "websocket", "app", "api", "command", "group", "task", "endpoint", "rpc", "handler", "listener", "subscribe")
