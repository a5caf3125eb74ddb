"""Exports, references, JSX usages and network calls of a parsed file."""

from __future__ import annotations

import re

from codelode.parse.languages import EXPORTS, JS_LIKE
from codelode.parse.source import Source
from codelode.parse.symbols import stable_id

#: Names known everywhere in a language, words that are no calls, client and method tables.
GLOBALS = {
    **{lang: frozenset("console window document process global globalThis Promise Array Object String Number Boolean Symbol Map Set WeakMap WeakSet Date RegExp Error TypeError RangeError JSON Math Intl Reflect Proxy parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent setTimeout setInterval clearTimeout clearInterval fetch require module exports queueMicrotask structuredClone requestAnimationFrame".split()) for lang in JS_LIKE},
    "python": frozenset("print len range enumerate zip map filter sorted reversed list dict set tuple int float str bool bytes type isinstance issubclass hasattr getattr setattr delattr super property staticmethod classmethod open input repr abs min max sum any all iter next id hash callable dir vars globals locals exec eval compile format chr ord hex oct bin round pow divmod complex".split()),
    "go": frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split()),
}
NO_CALL = frozenset("if for while switch catch return function class new typeof await yield elif else with match def lambda and or not in is assert except raise del print_ func go defer select case fn impl use struct enum loop try throw sizeof super this self foreach using lock when do end unless until elsif begin".split()) - {"print_"}
HTTP_METHODS = {
    **{m: m.upper() for m in "get post put patch delete head options".split()}, **{m: m.upper() for m in "Get Post Put Patch Delete Head".split()}, "PostForm": "POST", **{f"{m}Async": m.upper() for m in "Get Post Put Patch Delete".split()},
    "SendAsync": "UNKNOWN", "NewRequest": "UNKNOWN", "Do": "UNKNOWN", "send": "UNKNOWN", "execute": "UNKNOWN", "exchange": "UNKNOWN", "getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST",
}
JS_CLIENTS = {"fetch": "FETCH", "axios": "AXIOS", "ky": "KY"}
JS_VERBS = frozenset("get post put patch delete head options request".split())
GRAPHQL_CALLS = {"gql": "POST", "useMutation": "POST", "useQuery": "GET", "useLazyQuery": "GET", "useSubscription": "GET"}
GRAPHQL_CLIENTS = frozenset("graphqlClient apolloClient graphql gqlClient urqlClient".split())
CLIENTS = {
    "python": "requests httpx urllib aiohttp session client", "go": "http client", "rust": "reqwest hyper", "java": "restTemplate webClient HttpClient httpClient OkHttpClient okHttpClient", "csharp": "HttpClient httpClient _httpClient client _client WebClient webClient",
    "swift": "URLSession AF Alamofire", "ruby": "Net::HTTP Faraday HTTParty RestClient", "php": "Guzzle",
}
CLIENTS["kotlin"] = CLIENTS["java"]
CLIENT_SETS = {k: frozenset(v.split()) for k, v in CLIENTS.items()}
GO_METHODS = frozenset("Get Head Post PostForm Do".split())
CSHARP_METHODS = frozenset("GetAsync PostAsync PutAsync PatchAsync DeleteAsync SendAsync GetStringAsync GetByteArrayAsync GetStreamAsync".split())
CURL = frozenset("curl_init curl_exec curl_setopt curl_easy_init curl_easy_perform".split())


def exports(src: Source, path: str, symbols: list[dict], imports: list[dict]) -> list[dict]:
    """Export rows: by the export statements of JavaScript and its kin, elsewhere by the language's rule over symbols."""
    out: list[dict] = []
    by_name = {s["name"]: s["symbol_id"] for s in reversed(symbols) if not s["parent_symbol_id"]}

    def add(kind: str, name: str, local: str, module: str, at: int) -> None:
        line, column = src.line(at), src.column(at)
        out.append({"export_id": stable_id("exp", path, kind, name, line), "file_path": path, "export_kind": kind, "exported_name": name, "local_name": local, "symbol_id": by_name.get(local, "") if not module else "", "source_module": module, "line": line, "column": column})

    if src.language in JS_LIKE:
        for m in re.finditer(r"^[ \t]*export\s+(?P<type>type\s+)?(?:(?P<all>\*)(?:\s+as\s+(?P<as>\w+))?\s*from\s*(?P<q1>[\"'])|\{(?P<list>[^}]*)\}(?:\s*from\s*(?P<q2>[\"']))?|default\s+(?:async\s+)?(?:(?:abstract\s+)?class|function\s*\*?)?\s*(?P<def>[\w$]*)|(?:declare\s+|abstract\s+|async\s+)*(?P<what>const|let|var|function\s*\*?|class|interface|enum|namespace|type)\s+(?P<name>[\w$]+|\{[^}]*\}|\[[^\]]*\]))", src.code, re.M):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            quote = m.start("q1") if m["q1"] else m.start("q2") if m["q2"] else -1
            module = re.match(r"[\"']([^\"'\n]*)", src.text[quote:])[1] if quote >= 0 else ""
            if m["all"]:
                add("EXPORT_ALL", m["as"] or "*", "", module, at)
            elif m["list"] is not None:
                for part in m["list"].split(","):
                    if words := part.split():
                        typed = words[0] == "type" and len(words) > 1
                        words = words[1:] if typed else words
                        add("REEXPORT" if module else "TYPE_ONLY" if typed or m["type"] else "DEFAULT" if words[-1] == "default" else "NAMED", words[-1], words[0], module, at)
            elif m["what"]:
                kind = "TYPE_ONLY" if m["what"] in ("interface", "type") else "NAMED"
                names = [m["name"]] if m["name"][0] not in "{[" else re.findall(r"([\w$]+)\s*(?:=[^,}\]]*)?(?:[,}\]]|$)", m["name"])
                for name in names:
                    add(kind, name, name, "", at)
            else:
                add("DEFAULT", "default", m["def"] or "", "", at)
    elif src.language == "python" and (m := re.search(r"^__all__\s*(?:\+?=)\s*[\[(]([^\])]*)[\])]", src.text, re.M)):
        for name in re.findall(r"[\"'](\w+)[\"']", m[1]):
            add("NAMED", name, name, "", m.start())
    elif EXPORTS.get(src.language):
        private = set()
        if src.language == "ruby":
            hidden = False
            for line in src.code.split("\n"):
                word = line.strip()
                hidden = True if word in ("private", "protected") else False if word in ("public", "end") and not line[:1].isspace() else hidden
                if hidden and (m := re.match(r"\s*def\s+(?:self\.)?([\w?!=]+)", line)):
                    private.add(m[1])
        for s in symbols:
            top = not s["parent_symbol_id"] or src.language in ("java", "csharp", "go", "rust", "kotlin", "swift", "ruby")
            mods = set(s["modifiers"])
            rule = {"php": not s["parent_symbol_id"], "kotlin": not mods & {"private", "internal"}, "ruby": s["name"] not in private, "swift": s["flags"]["is_exported"] or "open" in mods}
            if top and rule.get(src.language, s["flags"]["is_exported"]):
                add("NAMED", s["name"], s["name"], "", src.starts[s["start_line"] - 1])
                out[-1]["symbol_id"] = s["symbol_id"]
    return sorted(out, key=lambda e: (e["line"], e["column"], e["export_kind"], e["exported_name"]))


def imported_names(src: Source, imports: list[dict]) -> set[str]:
    """Names that imports bring into the file."""
    names = {re.split(r"[/.:\\]+", i["import_name"].rstrip("/"))[-1] for i in imports} | {i["import_name"] for i in imports}
    if src.language in JS_LIKE:
        for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^\"';]+?)\s+from\b", src.code, re.M):
            names |= set(re.findall(r"(?:as\s+)?([\w$]+)\s*(?:,|\}|$)", m[1]))
    elif src.language == "python":
        for m in re.finditer(r"^\s*from\s+[.\w]+\s+import\s+\(?([^)\n]*(?:\n[^)\n]*)*?)(?:\)|$)|^\s*import\s+(.+)$", src.code, re.M):
            names |= {p.split(" as ")[-1].strip().split(".")[0] for p in (m[1] or m[2] or "").split(",")}
    elif src.language == "rust":
        for m in re.finditer(r"\buse\s+[^;]*;", src.code):
            names |= set(re.findall(r"(\w+)\s*(?:[,};]|as\s)", m[0]))
    return {n for n in names if n}


def enclosing(symbols: list[dict], line: int) -> str:
    """The symbol with the fewest lines around a line, the first on ties."""
    around = [s for s in symbols if s["start_line"] <= line <= s["end_line"]]
    return min(around, key=lambda s: s["end_line"] - s["start_line"])["symbol_id"] if around else ""


def scope_of(name: str, hint: str, symbols: dict[str, str], imported: set[str], language: str) -> tuple[str, str]:
    """Scope of a reference and the symbol it means, if one of the file."""
    full = hint or name
    if "." in full or "::" in full:
        return ("IMPORTED" if re.split(r"\.|::", full)[0] in imported else "MEMBER"), ""
    if name in symbols:
        return "LOCAL", symbols[name]
    return ("IMPORTED" if name in imported else "GLOBAL" if name in GLOBALS.get(language, ()) else "UNKNOWN"), ""


def confidence(scope: str) -> str:
    return {"LOCAL": "HIGH", "IMPORTED": "HIGH", "MEMBER": "MEDIUM", "GLOBAL": "MEDIUM"}.get(scope, "LOW")


_CALL = re.compile(r"(?<![\w$.:>@])(?P<new>new\s+)?(?P<full>(?:[A-Za-z_$][\w$]*(?:\?\.|\.|::|->))*[A-Za-z_$][\w$!?]*)\s*(?:<[\w\s,.<>\[\]]*>)?\(")
_DECLARES = re.compile(r"(?:\bfunction\*?|\bdef|\bfunc|\bfn|\bfun|\bclass|\bstruct|\bsub)\s+(?:\([^)]*\)\s*)?$")
_TYPE = re.compile(r"(?<=[\w)\]?])\s*:\s*(?:readonly\s+)?([A-Z][\w$]*)")
_BASES = re.compile(r"\b(?:class|interface|struct)\s+[\w$]+(?:<[^{>]*>)?(?:\s+extends\s+(?P<ext>[\w$.,\s<>]+?))?(?:\s+implements\s+(?P<imp>[\w$.,\s<>]+?))?\s*\{")
_DECORATOR = re.compile(r"^[ \t]*@([A-Za-z_][\w.]*)", re.M)
_JSX = re.compile(r"(?<![\w$)\]])<(?P<name>[A-Za-z][\w.$]*)?(?=[\s/>])")


def jsx_usages(src: Source, symbols: list[dict]) -> list[dict]:
    """JSX elements and fragments that are opened."""
    if src.language not in ("jsx", "tsx"):
        return []
    by_name, out = {s["name"]: s["symbol_id"] for s in reversed(symbols)}, []
    for m in _JSX.finditer(src.code):
        name = m["name"] or ""
        if not name and not src.code.startswith("<>", m.start()):
            continue
        line, column = src.line(m.start()), src.column(m.start())
        intrinsic = bool(name) and name[0].islower() and "." not in name
        target = "" if intrinsic or not name else by_name.get(name.split(".")[0], "")
        out.append({"usage_id": stable_id("jsx", name or "Fragment", line, column), "source_symbol_id": enclosing(symbols, line), "component_name": name or "Fragment", "is_intrinsic": intrinsic, "is_fragment": not name, "line": line, "column": column, "resolved_target_symbol_id": target, "confidence": "HIGH" if target or intrinsic or not name else "MEDIUM"})
    return sorted(out, key=lambda u: (u["line"], u["column"], u["component_name"]))


def references(src: Source, path: str, symbols: list[dict], imports: list[dict], usages: list[dict]) -> list[dict]:
    """Calls, constructions, types, bases, decorators and component uses, one a kind, name and place."""
    by_name, imported, out, seen = {s["name"]: s["symbol_id"] for s in reversed(symbols)}, imported_names(src, imports), [], set()

    def add(kind: str, name: str, hint: str, at: int, end: int, raw: str) -> None:
        line, column = src.line(at), src.column(at)
        if (kind, name, line, column) in seen:
            return
        seen.add((kind, name, line, column))
        scope, target = scope_of(name, hint, by_name, imported, src.language)
        out.append({"reference_id": stable_id("ref", kind, name, line, column), "source_file_path": path, "source_symbol_id": enclosing(symbols, line), "reference_kind": kind, "raw_text": raw[:200], "target_name": name, "qualified_target_hint": hint, "start_line": line, "start_column": column, "end_line": src.line(end), "end_column": src.column(end), "resolution_scope": scope, "resolved_target_symbol_id": target, "confidence": confidence(scope)})

    for m in _CALL.finditer(src.code):
        full = re.sub(r"\?\.|->", ".", m["full"])
        name = re.split(r"\.|::", full)[-1]
        if name in NO_CALL or full in NO_CALL or _DECLARES.search(src.code, max(0, m.start() - 60), m.start("full")):
            continue
        if src.language in JS_LIKE and re.match(r"[^\n]*\)\s*(?::[^={]*)?\{", src.code[m.end() - 1 : m.end() + 300]) and re.search(r"\n[ \t]*(?:(?:public|private|protected|static|async|get|set)\s+)*$", src.code[: m.start("full")][-80:]) and "." not in full:
            continue
        hook, js = bool(re.match("use[A-Z]", name)), src.language in JS_LIKE
        kind = "NEW_EXPR" if m["new"] else "HOOK_USE" if js and hook else "FETCH" if js and full == "fetch" else "CALL"
        add(kind, name, full if full != name else "", m.start("full"), m.end("full"), src.text[m.start("full") : m.end("full")])
    if src.language in ("typescript", "tsx"):
        for m in _TYPE.finditer(src.code):
            add("TYPE_REF", m[1], "", m.start(1), m.end(1), m[1])
    for m in _BASES.finditer(src.code):
        for group, kind in (("ext", "EXTENDS"), ("imp", "IMPLEMENTS")):
            for x in re.finditer(r"[A-Za-z_$][\w$.]*(?=\s*(?:<|,|$))", m[group] or ""):
                at = m.start(group) + x.start()
                add(kind, x[0].split(".")[-1], x[0] if "." in x[0] else "", at, at + len(x[0]), x[0])
    if src.language == "python":
        for m in re.finditer(r"^[ \t]*class\s+\w+\s*\(([^)]*)\)", src.code, re.M):
            for x in re.finditer(r"(?:^|,)\s*([A-Za-z_][\w.]*)\s*(?=,|$)", m[1]):
                at = m.start(1) + x.start(1)
                add("EXTENDS", x[1].split(".")[-1], x[1] if "." in x[1] else "", at, at + len(x[1]), x[1])
    if src.language in (*JS_LIKE, "python", "java", "kotlin"):
        for m in _DECORATOR.finditer(src.code):
            add("DECORATOR", m[1].split(".")[-1], m[1] if "." in m[1] else "", m.start(1), m.end(1), m[1])
    for u in usages:
        if not u["is_intrinsic"] and not u["is_fragment"]:
            at = src.starts[u["line"] - 1] + u["column"] - 1
            name = u["component_name"]
            add("JSX_RENDER", name.split(".")[-1], name if "." in name else "", at, at + len(name), name)
    return sorted(out, key=lambda r: (r["start_line"], r["start_column"], r["reference_kind"], r["target_name"]))


def http_method(name: str) -> str:
    return HTTP_METHODS.get(name) or HTTP_METHODS.get(name.lower(), "UNKNOWN")


def relative_url(url: str) -> bool:
    return bool(url) and url != "<dynamic>" and not url.startswith("//") and (url.startswith(("/", "./", "../")) or "://" not in url)


def classify_call(target: str, receiver: str, language: str, after: str) -> tuple[str, str, str] | None:
    """Client kind, method and confidence of a call, None if it is no network call. after: the text of its arguments."""
    last = re.split(r"\.|::", receiver)[-1] if receiver else ""
    if language in JS_LIKE:
        if not receiver:
            if target in JS_CLIENTS:
                m = re.match(r"[^;]{0,400}?\bmethod\s*:\s*[\"'](\w+)[\"']", after, re.S) if target == "fetch" else None
                return JS_CLIENTS[target], m[1].upper() if m else "GET", "HIGH"
            return ("GRAPHQL", GRAPHQL_CALLS[target], "HIGH") if target in GRAPHQL_CALLS else None
        if receiver in ("axios", "ky"):
            return JS_CLIENTS[receiver], http_method(target), "HIGH"
        if target in ("query", "mutate", "request") and (receiver in GRAPHQL_CLIENTS or last in GRAPHQL_CLIENTS):
            return "GRAPHQL", "POST", "HIGH"
        return ("UNKNOWN", http_method(target), "MEDIUM") if target.lower() in JS_VERBS else None
    known = receiver in CLIENT_SETS.get(language, ())
    verb = target in HTTP_METHODS or target.lower() in HTTP_METHODS
    hit = {
        "python": known and verb, "go": known and target in GO_METHODS, "rust": known, "java": known, "kotlin": known, "csharp": known and (http_method(target) != "UNKNOWN" or target in CSHARP_METHODS), "ruby": known and verb or "Net::HTTP" in receiver,
        "swift": known or "URLSession" in receiver, "php": known and verb,
    }.get(language, False)
    if hit:
        return "UNKNOWN", "UNKNOWN" if language == "swift" else http_method(target), "HIGH"
    if language == "python" and target == "urlopen":
        return "UNKNOWN", "GET", "HIGH"
    if language == "php" and target == "file_get_contents":
        return "UNKNOWN", "GET", "MEDIUM"
    return ("UNKNOWN", "UNKNOWN", "HIGH") if language in ("php", "c", "cpp") and target in CURL else None


def network_calls(src: Source, symbols: list[dict]) -> list[dict]:
    """Calls of HTTP and GraphQL clients, with what can be told of their URL."""
    out = []
    for m in _CALL.finditer(src.code):
        full = re.sub(r"\?\.|->", ".", m["full"])
        cut = max(full.rfind("."), full.rfind("::"))
        target = full[cut + (2 if full[cut : cut + 2] == "::" else 1) :] if cut >= 0 else full
        found = classify_call(target, full[:cut] if cut >= 0 else "", src.language, src.text[m.end() : m.end() + 400])
        if not found:
            continue
        literal = template = ""
        if a := re.match(r"\s*(?:\[\s*)?([\"'`])((?:\\.|(?!\1).)*)\1", src.text[m.end() :], re.S):
            if a[1] == "`" and "${" in a[2]:
                template = re.sub(r"\$\{[^}]*\}", "{*}", a[2])
            else:
                literal = a[2]
        elif found[0] != "GRAPHQL" and not src.text[m.end() :].lstrip().startswith(")"):
            template = "<dynamic>"
        line, column = src.line(m.start("full")), src.column(m.start("full"))
        out.append({"network_call_id": stable_id("net", found[0], found[1], line, column), "source_symbol_id": enclosing(symbols, line), "client_kind": found[0], "method": found[1], "url_literal": literal, "url_template": template, "is_relative": relative_url(literal or template), "start_line": line, "start_column": column, "confidence": found[2]})
    return sorted(out, key=lambda c: (c["start_line"], c["start_column"], c["client_kind"]))
