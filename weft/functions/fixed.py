"""Values of the data model that results depend on: fixed values, kept as they are, in natural order."""

#: Names of calls that say nothing about a program (fixed values).
NOISE = tuple("""
console log warn error info debug
setTimeout setInterval clearTimeout clearInterval
parseInt parseFloat isNaN isFinite
encodeURI decodeURI encodeURIComponent decodeURIComponent
JSON parse stringify
Object Array String Number Boolean Symbol BigInt
Map Set WeakMap WeakSet
Promise resolve reject then catch finally
Math Date RegExp Error
require import export
fetch Response Request
useState useEffect useCallback useMemo useRef useContext
useReducer useLayoutEffect useImperativeHandle useDebugValue
createElement createContext createRef forwardRef memo lazy
map filter reduce forEach find findIndex some every
includes indexOf slice splice concat join split
push pop shift unshift sort reverse
keys values entries assign freeze seal
hasOwnProperty toString valueOf
print len range str int float list dict set tuple
open read write close append extend update
super type isinstance issubclass getattr setattr hasattr
enumerate zip sorted reversed min max sum abs
""".split())  # fmt: skip

#: Words left out of keyword search (fixed values).
STOP_WORDS = tuple("""
const let var function return if else for while
class new this import export from default async await
try catch throw typeof instanceof true false null undefined
the is at which on a an and or but in with
to of it be as by that for are was were
""".split())  # fmt: skip

#: Name patterns of entry points by language, '*' for all (fixed values).
ENTRY_NAMES = {
    "*": ["^(?i:main|init|bootstrap|start|run|setup|configure)$", "^handle[A-Z]", "^on[A-Z]", "Handler$", "Controller$", "^process[A-Z]", "^execute[A-Z]", "^perform[A-Z]", "^dispatch[A-Z]", "^trigger[A-Z]", "^fire[A-Z]", "^emit[A-Z]"],
    "javascript": ["^use[A-Z]"],
    "typescript": ["^use[A-Z]"],
    "python": ["^app$", "^(?i:get|post|put|delete|patch)_", "^api_", "^view_"],
    "java": ["^do[A-Z]", "^create[A-Z]", "^build[A-Z]", "Service$"],
    "csharp": ["^(Get|Post|Put|Delete)", "Action$", "^On[A-Z]", "Async$"],
    "go": ["Handler$", "^Serve", "^New[A-Z]", "^Make[A-Z]"],
    "rust": ["^(?i:get|post|put|delete)_(?i:handler)$", "^handle_", "^new$", "^run$", "^spawn"],
    "c": ["^main$", "^init_", "^start_", "^run_"],
    "cpp": ["^main$", "^init_", "^Create[A-Z]", "^Run$", "^Start$"],
}
#: Name patterns of helpers (fixed values).
UTILITY_NAMES = ["^(get|set|is|has|can|should|will|did)[A-Z]", "^_", "^(?i:format|parse|validate|convert|transform)", "^(?i:log|debug|error|warn|info)$", "^(to|from)[A-Z]", "^(?i:encode|decode)", "^(?i:serialize|deserialize)", "^(?i:clone|copy|deep)", "^(?i:merge|extend|assign)", "^(?i:filter|map|reduce|sort|find)", "Helper$", "Util$", "Utils$", "^(?i:utils?)$", "^(?i:helpers?)$"]
#: What makes a path one of a test: for impact, for entry points and for the report of dependants (fixed values).
TEST_PATHS = {
    "impact": (("has", ".test."), ("has", ".spec."), ("has", "__tests__/"), ("has", "__mocks__/"), ("has", "/test/"), ("has", "/tests/"), ("has", "/testing/"), ("has", "/fixtures/"), ("ends", "_test.go"), ("ends", "_test.py"), ("has", "/test_"), ("has", "/conftest.")),
    "entry": (("has", ".test."), ("has", ".spec."), ("has", "__tests__/"), ("has", "__mocks__/"), ("has", "/test/"), ("has", "/tests/"), ("has", "/testing/"), ("ends", "_test.py"), ("has", "/test_"), ("ends", "_test.go"), ("has", "/src/test/"), ("has", ".tests/"), ("has", "tests.cs")),
    "report": (("has", ".test."), ("has", ".spec."), ("has", "__tests__"), ("has", "__mocks__")),
}
