"""Paths, globs, languages and remote addresses as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANGUAGES = """
bash:bash,sh c:c,h clojure:clj,cljc,cljs cmake:cmake cpp:cc,cpp,cxx,hpp,hxx crystal:cr csharp:cs css:css dart:dart dockerfile:dockerfile
elixir:ex,exs erlang:erl,hrl fish:fish fsharp:fs,fsi,fsx go:go groovy:groovy haskell:hs,lhs html:htm,html ini:cfg,ini java:java
javascript:cjs,js,mjs json:json jsx:jsx julia:jl kotlin:kt,kts less:less lua:lua make:makefile,mk markdown:markdown,md mdx:mdx nim:nim nix:nix
ocaml:ml,mli php:php powershell:ps1,psm1 python:py,pyi,pyx r:r,rmd rst:rst ruby:gemspec,rake,rb rust:rs sass:sass scala:scala scss:scss sql:sql
svelte:svelte swift:swift terraform:tf,tfvars text:txt toml:toml tsx:tsx typescript:cts,mts,ts vlang:v vue:vue xml:xml yaml:yaml,yml zig:zig zsh:zsh
"""
LANGUAGE_OF = {e: lang for lang, exts in (x.split(":") for x in _LANGUAGES.split()) for e in exts.split(",")}
_CORE = "c cc cpp cs css cxx go h hpp html java js json jsx kt kts md php py rb rs scala scss swift toml ts tsx xml yaml yml zig".split()
_MORE = [*_CORE, *"bash cjs htm markdown mjs pyi sh sql".split()]
#: Shorter tables of the other entry points.
PROFILES = {
    "cli": LANGUAGE_OF,
    "binding": {e: LANGUAGE_OF[e] for e in [*_MORE, *"cts hxx mts pyx rake".split()]},
    "mmap": {e: LANGUAGE_OF[e] for e in [*_MORE, "lua"]} | {"pyw": "python", "sass": "scss"},
    "wasm": {e: LANGUAGE_OF[e] for e in _CORE} | {"jsx": "javascript", "tsx": "typescript", "h": "cpp", "sass": "scss"},
}
#: Languages whose symbols can be extracted, by extension.
PARSED = dict(go="go", java="java", js="javascript", jsx="javascript", py="python", pyw="python", rs="rust", ts="typescript", tsx="typescript", mjs="javascript", cjs="javascript")
BINARY = tuple(sorted("7z a avi bin bmp bz2 cache class dat db dll doc docx dylib ear eot exe flac gif gz ico jar jpeg jpg lib lock mkv mov mp3 mp4 o obj odt ogg otf pdf png ppt pptx psd pyc pyo rar so sqlite sqlite3 sum svg tar tgz tiff ttf war wav webm webp woff woff2 xls xlsx xz zip".split()))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension, or null: a leading dot alone makes none."""
    e = F.lower(F.regexp_extract(filename(path), r"^.+\.([^.]*)$", 1))
    return F.when(e != "", e)


def language(path: Column, profile: str = "cli") -> Column:
    """By the last extension, in any case but for the wasm profile, which takes it as written."""
    table = F.create_map(*(F.lit(x) for kv in PROFILES[profile].items() for x in kv))
    e = F.regexp_extract(filename(path), r"^.+\.([^.]*)$", 1) if profile == "wasm" else extension(path)
    return F.try_element_at(table, F.coalesce(e, F.lit("")))


def mermaid_id(name: Column) -> Column:
    return F.translate(name, "-.", "__")


_TOP = ("main", "index", "app", "server", "lib")
ENTRIES = tuple(f"{a}.{b}" for a, bs in {"main": "c cpp go js py rs ts", "index": "js jsx py ts tsx", "app": "go js jsx py ts tsx", "server": "go js py ts", "lib": "rs", "mod": "rs", "__main__": "py", "__init__": "py"}.items() for b in bs.split())
CONFIGS = tuple(sorted("CMakeLists.txt Cargo.toml Dockerfile Gemfile Makefile build.gradle docker-compose go.mod next.config package.json pom.xml pyproject.toml requirements.txt setup.cfg setup.py tsconfig.json vite.config webpack.config .env.example config.json config.yaml config.yml".split()))


def _any(items) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | x
    return out


def is_entry_point(path: Column) -> Column:
    """A path that ends with, or has below a folder, the name of an entry file."""
    return _any(path.endswith(x) | path.contains("/" + x) for x in ENTRIES)


def entry_type(path: Column) -> Column:
    out = F.when(path.contains(_TOP[0]), F.lit(_TOP[0]))
    for x in _TOP[1:4]:
        out = out.when(path.contains(x), F.lit(x))
    return out.when(path.contains("lib"), "library").when(path.contains("mod.rs"), "module").otherwise("entry")


def is_config(path: Column) -> Column:
    """The name holds that of a configuration file, at the root or one folder below."""
    return _any(filename(path).contains(x) for x in CONFIGS) & (F.size(F.split(path, "/")) <= 2)


def parser_language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in PARSED.items() for x in kv))
    return F.try_element_at(table, F.coalesce(extension(path), F.lit("")))


def is_binary_name(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY), F.lit(False))


def module(path: Column) -> Column:
    """First component: the file's own name at the root."""
    return F.split(path, "/")[0]


def dotted_module(path: Column) -> Column:
    """src/foo/bar.py -> foo.bar: source folders stripped in order, the extension cut, slashes to dots."""
    p = path
    for d in ("src", "lib", "app"):
        p = F.regexp_replace(p, f"^(?:{d}/)+", "")
    p = F.regexp_replace(p, r"\.[^.]*$", "")
    return F.regexp_replace(F.translate(p, "/", "."), r"^\.+|\.+$", "")


def normalise(path: Column) -> Column:
    """``.`` and ``..`` resolved; above the root they do nothing."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(out, "/")


def bucket(importance: Column) -> Column:
    return F.when(importance > 0.8, "critical").when(importance > 0.6, "high").when(importance > 0.3, "normal").otherwise("low")


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` cross slashes and patterns are anchored; only ``**/`` in front may start at any slash."""
    any_start = glob.startswith("**/")
    out, i, body = "", 0, glob[3:] if any_start else glob
    while i < len(body):
        c = body[i]
        if c == "*":
            while body[i : i + 1] == "*":
                i += 1
            if i < len(body) and body[i] == "/" and body[max(0, i - 2) : i] == "**":
                out += "(?:.*/)?"
                i += 1
            else:
                out += ".*"
            continue
        if c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        out += "." if c == "?" else re.escape(c)
        i += 1
    return ("(?:.*/)?" if any_start else "") + out


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """One compiled alternation; no patterns match nothing."""
    if not globs:
        return F.lit(False)
    return path.rlike("^(?s:" + "|".join(glob_to_regex(g) for g in globs) + ")$")


_HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}


def is_remote(url: Column) -> Column:
    """A URL with a scheme, a host shorthand, an ssh address, or any a/b with exactly one slash."""
    return url.rlike(r"^(https?://|git://|ssh://|git@|(github|gitlab|bitbucket):)") | (url.rlike(r"^[^/]+/[^/]+$") & ~url.rlike(r"^[./]"))


def remote(url: Column) -> Column:
    """Struct of provider, owner, name, branch and subdir; generic where the host is not a known one."""
    short = r"^(github|gitlab|bitbucket):"
    host = F.when(url.rlike("^git@"), F.regexp_extract(url, r"^git@([^:]+):", 1)).when(url.rlike("^[a-z]+://"), F.regexp_extract(url, r"^[a-z]+://(?:[^@/]+@)?([^/:]+)", 1))
    provider = F.when(url.rlike(short), F.regexp_extract(url, short, 1)).when(host.isNull(), F.lit("github"))
    for h, p in _HOSTS.items():
        provider = provider.when(host == h, F.lit(p))
    provider = provider.otherwise(F.lit("generic"))
    rest = F.regexp_replace(url, r"^(?:git@[^:]+:|[a-z]+://[^/]+/?|(?:github|gitlab|bitbucket):)", "")
    part = F.split(rest, "/")
    tail = F.regexp_extract(rest, r"^[^/]+/[^/]+/(?:-/)?(?:tree|blob)/(.+)$", 1)
    some = lambda c: F.when(c != "", c)
    return F.struct(
        provider.alias("provider"), some(F.try_element_at(part, F.lit(1))).alias("owner"), some(F.regexp_replace(F.try_element_at(part, F.lit(2)), r"\.git$", "")).alias("name"),
        some(F.regexp_extract(tail, "^([^/]+)", 1)).alias("branch"), some(F.regexp_extract(tail, "^[^/]+/(.+)$", 1)).alias("subdir"),
    )


def package_name(specifier: Column) -> Column:
    """@scope/pkg/x -> @scope/pkg; pkg/x -> pkg."""
    return F.when(specifier.startswith("@"), F.regexp_extract(specifier, "^(@[^/]+(?:/[^/]+)?)", 1)).otherwise(F.split(specifier, "/")[0])
