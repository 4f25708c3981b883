"""Fixed values that must equal the analysed tool's behaviour.

Everything in this module is a literal table stated in natural order; the
operators only look values up here.
"""

# --- FIXED VALUES: file extension -> language label (35 entries; the
# --- `.svelte` entry is the documented intent, see README "ledger").
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "react",
    ".tsx": "react-typescript",
    ".vue": "vue",
    ".java": "java",
    ".cpp": "c++",
    ".c": "c",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "c#",
    ".swift": "swift",
    ".kt": "kotlin",
    ".r": "r",
    ".scala": "scala",
    ".m": "objective-c",
    ".h": "header",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
    ".html": "html",
    ".xml": "xml",
    ".json": "json",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".md": "markdown",
    ".txt": "text",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
    ".svelte": "svelte",
}
UNKNOWN_LANGUAGE = "unknown"

# --- FIXED VALUES: names ignored as a whole file/dir name or as any path part.
IGNORE_NAMES = [
    "__pycache__", "node_modules", ".git", ".svn", ".hg",
    "venv", "env", ".env", ".venv", "build", "dist",
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib",
    ".class", ".o", ".obj",
    ".DS_Store", ".gitignore", ".gitattributes",
]

# --- FIXED VALUES: language allow-lists.
ANALYSABLE_LANGUAGES = ["python", "javascript", "typescript", "react", "react-typescript",
                        "c++", "c", "c#", "svelte"]
QUALITY_LANGUAGES = ["python", "javascript", "typescript", "c++", "c#", "svelte"]
JS_FAMILY = ["javascript", "typescript", "react", "react-typescript"]
CPP_FAMILY = ["c++", "c"]

# --- FIXED VALUES: entry-point file names (compared lower-cased).
ENTRY_POINT_NAMES = ["main.py", "app.py", "run.py", "index.js", "main.js", "app.js",
                     "index.ts", "main.ts", "app.ts", "main.java", "app.java", "main.go", "main.rs"]

# --- FIXED VALUES: smell thresholds and messages.
SMELL_THRESHOLDS = {
    "max_function_length": 50,
    "max_class_length": 200,
    "max_parameters": 5,
    "max_complexity": 10,
    "max_nesting_depth": 3,
}
MSG_LONG_METHOD = "Method is {n} lines long (max {m})"
MSG_TOO_MANY_PARAMS = "Method has {n} parameters (max {m})"
MSG_DEEP_NESTING = "Code is nested {n} levels deep (max {m})"
MSG_LARGE_CLASS = "Class is {n} lines long (max {m})"
MSG_LONG_LINE = "Line exceeds 120 characters"
MSG_COMPLEX_CONDITION = "Condition is too complex"
MSG_NESTED_BLOCKS = "Too many nested blocks"
MSG_MULTIPLE_STYLES = "Multiple style blocks should be consolidated"

# --- FIXED VALUES: side-effect calls and messages of the behaviour analysis.
SIDE_EFFECT_CALLS = ["print", "open", "write", "input"]

# --- FIXED VALUES: design-pattern labels.
COMMON_PATTERNS = ["Factory", "Singleton", "Observer", "Strategy", "Decorator"]

# --- FIXED VALUES: suggestion texts.
SUGGEST_NO_CODE = "- This appears to be a non-code project or contains no analyzable source files"
SUGGEST_FUNC_DOCS = "- Consider adding docstrings to functions to improve code documentation"
SUGGEST_CLASS_DOCS = "- Consider adding docstrings to classes to improve code documentation"
SUGGEST_SMELL = {
    "Long Method": "- Consider refactoring long methods ({n} instances found). Break them down into smaller, more focused functions",
    "Large Class": "- Consider splitting large classes ({n} instances found). Use composition or inheritance to distribute responsibilities",
    "Deep Nesting": "- Reduce deep nesting ({n} instances found). Extract complex conditions into well-named functions or use guard clauses",
    "Too Many Parameters": "- Methods with too many parameters ({n} instances found). Consider using parameter objects or builder pattern",
}
SUGGEST_PATTERNS_HEADER = "\nConsider implementing these design patterns where appropriate:"
SUGGEST_PATTERN = {
    "Factory": "- Factory Pattern: For flexible object creation and encapsulating instantiation logic",
    "Singleton": "- Singleton Pattern: For managing shared resources or global state",
    "Observer": "- Observer Pattern: For implementing event handling and loose coupling",
    "Strategy": "- Strategy Pattern: For making algorithms interchangeable and reducing conditional complexity",
    "Decorator": "- Decorator Pattern: For adding behavior to objects dynamically",
}

# --- FIXED VALUES: Python builtins and the names that every module has; reading them is no
# "global variable" read (ledger Q13)
PY_BUILTINS = """
ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError
BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError ConnectionRefusedError
ConnectionResetError DeprecationWarning EOFError Ellipsis EncodingWarning EnvironmentError Exception
ExceptionGroup False FileExistsError FileNotFoundError FloatingPointError FutureWarning GeneratorExit IOError
ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError
KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError None NotADirectoryError NotImplemented
NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError ProcessLookupError
PythonFinalizationError RecursionError ReferenceError ResourceWarning RuntimeError RuntimeWarning
StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError True
TypeError UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError UnicodeTranslateError
UnicodeWarning UserWarning ValueError Warning ZeroDivisionError abs aiter all anext any ascii bin bool
breakpoint bytearray bytes callable chr classmethod compile complex copyright credits delattr dict dir divmod
enumerate eval exec exit filter float format frozenset getattr globals hasattr hash help hex id input int
isinstance issubclass iter len license list locals map max memoryview min next object oct open ord pow print
property quit range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars
zip
__name__ __file__ __doc__ __package__ __spec__ __loader__ __path__ __builtins__ __import__ __debug__
__build_class__ __annotations__
""".split()
