"""Scalar functions over text, names, paths and roles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths that identifiers and messages are cut to.
ID_HEX, SHORT_HASH, SIGNATURE = 16, 7, 200


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_newlines(c: Column) -> Column:
    """Without a byte order mark, and with \\n for every line end."""
    return F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), "\r\n?", "\n")


def count_lines(c: Column) -> Column:
    """Lines of a text; a line end at the end does not start another one."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (ends + F.when((c == "") | F.endswith(c, F.lit("\n")), 0).otherwise(1)).cast("long")


def line_range(c: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last (from 1, both included, within bounds) of a text, joined by \\n."""
    lines = F.split(F.regexp_replace(c, "\n$", ""), "\n", -1)
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    low, high = F.greatest(a, F.lit(1)), F.least(b, F.size(lines))
    return F.when((c == "") | (low > high), "").otherwise(F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n"))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(c) + 3) / 4).cast("long")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the start of the SHA-256 of the parts joined by colons."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, ID_HEX))


def short_hash(c: Column) -> Column:
    return F.substring(c, 1, SHORT_HASH)


def subject(c: Column) -> Column:
    """First line of a message."""
    return F.substring_index(c, "\n", 1)


def signature(c: Column) -> Column:
    """First line of a declaration without its body: cut at the first { or else the last =>, at most 200 characters."""
    line = F.trim(F.substring_index(F.trim(c), "\n", 1))
    cut = F.when(F.contains(line, F.lit("{")), F.rtrim(F.substring_index(line, "{", 1))).when(F.contains(line, F.lit("=>")), F.rtrim(F.regexp_replace(line, "=>(?!.*=>).*$", "=>"))).otherwise(line)
    return F.when(F.length(cut) > SIGNATURE, F.concat(F.substring(cut, 1, SIGNATURE), F.lit("..."))).otherwise(cut)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory of a path; . for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def role_rank(role: Column, kind: str = "member") -> Column:
    """Rank of a role; unknown ones have 0 and so never suffice. kind: member (project roles) or key (key roles)."""
    ranks = {"member": {"owner": 3, "admin": 2, "member": 1}, "key": {"write": 2, "read": 1}}[kind]
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def key_role(member_role: Column) -> Column:
    """The key role that a membership gives."""
    return F.when(member_role.isin("owner", "admin"), "write").when(member_role == "member", "read").otherwise("")


def masked_email(email: Column, role: Column) -> Column:
    """An address for owners and admins only."""
    return F.when(role_rank(role) >= 2, email)


def is_relative_url(url: Column) -> Column:
    return (url != "") & (url != "<dynamic>") & ~F.startswith(url, F.lit("//")) & (url.rlike(r"^\.{0,2}/") | ~F.contains(url, F.lit("://")))


def is_hook_name(name: Column) -> Column:
    return name.rlike("^use[A-Z]")


def version_label(provider: Column, model: Column, dims: Column) -> Column:
    """provider-model-dims with / as -."""
    return F.replace(F.concat_ws("-", provider, model, dims.cast("string")), F.lit("/"), F.lit("-"))


def collection_name(project: Column, label: Column) -> Column:
    return F.concat(F.lit("project_"), project.cast("string"), F.lit("__emb_"), label)


def redact_credentials(text: Column) -> Column:
    """URLs without user and password."""
    return F.regexp_replace(text, r"://[^@/\s]+@", "://***@")


def normalize_repo_url(url: Column) -> Column:
    """A repository address without scheme, user, trailing slash and .git; host:path counts as host/path."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "^[a-z+]+://", ""), "^[^@/]+@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, "^([^/:]+):(?![0-9]+/)", "$1/"), r"(\.git)?/*$", ""))


def go_module(text: Column) -> Column:
    """The module path that a go.mod declares; empty if none."""
    return F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1)
