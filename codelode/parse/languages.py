"""The languages known, with what the extractors need of each.

Everything in upper case below is fixed values: they decide classifications and must stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TIERS = {
    1: "javascript typescript jsx tsx python go rust java kotlin c cpp csharp swift ruby php".split(),
    2: "bash sql graphql dockerfile hcl".split(),
    3: "html css scss json yaml toml markdown xml".split(),
}
EXTENSIONS = {
    "javascript": ".js .mjs .cjs", "typescript": ".ts", "jsx": ".jsx", "tsx": ".tsx", "python": ".py .pyw .pyi", "go": ".go", "rust": ".rs", "java": ".java", "kotlin": ".kt .kts", "c": ".c",
    "cpp": ".cpp .cc .cxx .hpp .hxx .h", "csharp": ".cs", "swift": ".swift", "ruby": ".rb .rake .gemspec", "php": ".php", "bash": ".sh .bash .zsh", "sql": ".sql", "graphql": ".graphql .gql",
    "dockerfile": ".dockerfile", "hcl": ".tf .tfvars .tofu", "html": ".html .htm", "css": ".css", "scss": ".scss", "json": ".json .jsonc", "yaml": ".yaml .yml", "toml": ".toml", "markdown": ".md .markdown .mdx",
    "xml": ".xml .svg .xsl .xsd .plist",
}
BASENAMES = {"Dockerfile": "dockerfile", "Gemfile": "ruby", "Rakefile": "ruby", "Makefile": "bash", ".bashrc": "bash", ".zshrc": "bash", ".bash_profile": "bash", ".profile": "bash"}
JS_LIKE = ("javascript", "typescript", "jsx", "tsx")
#: keyword, prefix, convention, all_public or none
EXPORTS = {lang: "keyword" for lang in (*JS_LIKE, "rust", "java", "csharp", "swift", "php")} | {"python": "prefix", "go": "convention", "kotlin": "all_public", "c": "all_public", "cpp": "all_public", "ruby": "all_public"}
_NODE = (
    "fs path os util events stream http https url querystring crypto zlib buffer child_process cluster dgram dns net readline repl tls tty v8 vm worker_threads perf_hooks async_hooks diagnostics_channel inspector "
    "trace_events wasi assert console process timers module"
)
STDLIB = {
    **{lang: _NODE for lang in JS_LIKE},
    "python": "sys os re json typing collections pathlib io math datetime logging unittest functools itertools abc argparse asyncio base64 binascii bisect calendar codecs copy csv ctypes dataclasses decimal difflib email "
    "enum errno glob hashlib heapq hmac html http importlib inspect ipaddress locale marshal mimetypes multiprocessing operator pickle platform pprint queue random secrets select shelve shlex shutil signal socket "
    "sqlite3 ssl stat string struct subprocess tempfile textwrap threading time timeit traceback types urllib uuid warnings weakref xml zipfile zlib",
    "go": "fmt io io/fs os os/exec os/signal os/user bufio bytes strings strconv unicode unicode/utf8 sort slices maps cmp iter container/heap container/list container/ring encoding encoding/json encoding/xml "
    "encoding/base64 encoding/csv encoding/hex encoding/binary encoding/pem encoding/gob encoding/ascii85 crypto crypto/sha256 crypto/sha512 crypto/md5 crypto/tls crypto/x509 crypto/rand crypto/aes crypto/hmac "
    "crypto/ecdsa crypto/ed25519 crypto/rsa crypto/elliptic crypto/subtle net net/http net/http/httptest net/http/httputil net/url net/smtp net/rpc net/mail net/textproto sync sync/atomic context testing "
    "testing/fstest testing/iotest runtime runtime/debug runtime/pprof reflect unsafe embed log log/slog path path/filepath flag regexp text/template html/template text/scanner text/tabwriter math math/big math/rand "
    "hash hash/crc32 hash/fnv time errors compress/gzip compress/zlib compress/flate archive/zip archive/tar database/sql database/sql/driver go/ast go/parser go/token go/format go/types go/build go/doc go/printer html "
    "mime mime/multipart expvar image image/png image/jpeg plugin debug/elf debug/dwarf",
    "rust": "std",
    "c": "stdio.h stdlib.h string.h math.h ctype.h errno.h float.h limits.h locale.h setjmp.h signal.h stdarg.h stddef.h time.h assert.h stdbool.h stdint.h inttypes.h complex.h fenv.h tgmath.h wchar.h wctype.h threads.h "
    "stdatomic.h uchar.h unistd.h fcntl.h sys/types.h sys/stat.h pthread.h",
    "cpp": "iostream vector string map unordered_map set unordered_set algorithm memory utility functional numeric array deque list queue stack tuple optional variant any filesystem chrono thread mutex "
    "condition_variable future regex random cmath cstdlib cstring cstdio cassert stdexcept typeinfo type_traits concepts ranges format span coroutine",
    "csharp": "System Microsoft",
    "swift": "Foundation UIKit SwiftUI Combine CoreData CoreGraphics CoreLocation MapKit AVFoundation XCTest os Darwin",
    "ruby": "json net/http fileutils csv yaml set ostruct open-uri uri digest base64 date time pathname tempfile logger socket openssl erb cgi webrick optparse benchmark singleton forwardable delegate observer pp English "
    "abbrev strscan",
}
STDLIB_PREFIXES = {**{lang: ("node:",) for lang in JS_LIKE}, "rust": ("std::",), "java": ("java.", "javax."), "kotlin": ("kotlin.", "kotlinx."), "csharp": ("System.", "Microsoft.")}
INTERNAL_PREFIXES = {**{lang: ("./", "../") for lang in (*JS_LIKE, "bash", "hcl", "html", "css", "scss", "markdown")}, "python": (".",), "rust": ("crate::", "super::", "self::"), "ruby": ("./",)}
TEST_FILES = {
    **{lang: "*.test.* *.spec.* **/__tests__/**" for lang in JS_LIKE}, "python": "test_*.py *_test.py **/tests/**/*.py", "go": "*_test.go", "rust": "**/tests/**/*.rs", "java": "*Test.java *Tests.java **/src/test/**/*.java",
    "kotlin": "*Test.kt *Tests.kt **/src/test/**/*.kt", "cpp": "*_test.cpp *_test.cc *Test.cpp", "csharp": "*Test.cs *Tests.cs **/*Test*/**/*.cs", "swift": "*Tests.swift **/*Tests/**/*.swift",
    "ruby": "*_spec.rb *_test.rb **/spec/**/*.rb **/test/**/*.rb", "php": "*Test.php **/tests/**/*.php", "bash": "*.bats test_*.sh",
}
CONFIG_FILES = {
    **{lang: "*.config.*" for lang in JS_LIKE}, "python": "setup.py setup.cfg pyproject.toml requirements*.txt Pipfile tox.ini", "go": "go.mod go.sum", "rust": "Cargo.toml Cargo.lock",
    "java": "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts", "kotlin": "build.gradle.kts settings.gradle.kts", "c": "Makefile CMakeLists.txt configure.ac meson.build",
    "cpp": "CMakeLists.txt Makefile meson.build conanfile.txt conanfile.py vcpkg.json", "csharp": "*.csproj *.sln Directory.Build.props nuget.config", "swift": "Package.swift", "ruby": "Gemfile Rakefile *.gemspec",
    "php": "composer.json composer.lock phpunit.xml php.ini", "bash": ".bashrc .zshrc .bash_profile", "dockerfile": "Dockerfile Dockerfile.* *.dockerfile", "hcl": "*.tf *.tfvars *.tofu terraform.tfvars *.auto.tfvars",
    "json": "package.json tsconfig.json composer.json .eslintrc.json", "xml": "pom.xml web.xml AndroidManifest.xml *.csproj",
}
TEST_BLOCKS = {
    **{lang: [r"^\s*(?:describe|it|test)\s*\("] for lang in JS_LIKE}, "python": [r"^\s*def\s+test_", r"^\s*class\s+Test"], "go": [r"^func\s+Test[A-Z]", r"^func\s+Benchmark[A-Z]"], "rust": [r"#\[test\]", r"#\[cfg\(test\)\]"],
    "java": ["@Test", "@ParameterizedTest"], "kotlin": ["@Test"], "csharp": [r"\[Test\]", r"\[Fact\]", r"\[Theory\]"], "swift": [r"func\s+test[A-Z]"], "ruby": [r"^\s*(?:describe|it|context|specify)\s", r"^\s*def\s+test_"],
    "php": ["@test", r"public\s+function\s+test[A-Z]"],
}
CONFIG_NAMES = (
    "package.json tsconfig webpack.config vite.config babel.config .babelrc .eslintrc jest.config rollup.config next.config nuxt.config tailwind.config postcss.config prettier .prettierrc go.mod go.sum cargo.toml "
    "pyproject.toml setup.py setup.cfg gemfile rakefile makefile dockerfile .env .gitignore .dockerignore"
).split()
#: Files that stand for their directory: stem to the extensions that count.
INDEX_FILES = {"index": ".ts .tsx .js .jsx .mjs .cjs", "mod": ".rs", "__init__": ".py .pyi"}


@dataclass(frozen=True)
class Language:
    """One language."""

    name: str
    tier: int
    extensions: tuple[str, ...]
    exports: str = "none"
    stdlib: frozenset[str] = frozenset()
    stdlib_prefixes: tuple[str, ...] = ()
    internal_prefixes: tuple[str, ...] = ()
    test_files: list[str] = field(default_factory=list)
    config_files: list[str] = field(default_factory=list)
    test_blocks: list[str] = field(default_factory=list)


LANGUAGES = {
    name: Language(
        name, tier, tuple(EXTENSIONS[name].split()), EXPORTS.get(name, "none"), frozenset(STDLIB.get(name, "").split()), STDLIB_PREFIXES.get(name, ()), INTERNAL_PREFIXES.get(name, ()), TEST_FILES.get(name, "").split(),
        CONFIG_FILES.get(name, "").split(), TEST_BLOCKS.get(name, []),
    )
    for tier, names in TIERS.items()
    for name in names
}
BY_EXTENSION = {e: lang.name for lang in LANGUAGES.values() for e in lang.extensions}


def detect(path: str) -> str | None:
    """The language of a path: by its name, else by its extension."""
    base = path.rpartition("/")[2]
    if base in BASENAMES:
        return BASENAMES[base]
    dot = base.rfind(".")
    return BY_EXTENSION.get(base[dot:].lower()) if dot >= 0 else None


def detect_column(path):
    """detect() as a column expression."""
    from pyspark.sql import functions as F

    from codelode.functions.text import basename, extension

    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.element_at(table(BASENAMES), basename(path)), F.element_at(table(BY_EXTENSION), extension(path)))


def parsed_column(path):
    """Whether a path goes to the parser rather than to raw chunking: its extension alone decides."""
    from pyspark.sql import functions as F

    from codelode.functions.text import extension

    return extension(path).isin(*BY_EXTENSION) & F.lit(True)
