"""Text functions on columns. All but ``normalize_pseudocode`` are built-in expressions."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def quoted(c: Column) -> Column:
    """A column's text as a regular expression that matches it literally."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def first_longest(texts: Column) -> Column:
    """The longest text of an array, the first on a tie; null for an empty array."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best))


def fenced(c: Column, languages: str = "c|cpp|c\\+\\+") -> Column:
    """Contents of fenced blocks that are tagged with one of ``languages`` or untagged."""
    return F.regexp_extract_all(c, F.lit(f"(?is)```(?:{languages})?\\s*\\n?(.*?)```"), 1)


def markdown_fence(c: Column) -> Column:
    """struct<code, blocks>: the longest fenced block, stripped; without one, the stripped text and 0 blocks."""
    blocks = fenced(c)
    return F.struct(strip(F.coalesce(first_longest(blocks), c)).alias("code"), F.size(blocks).alias("blocks"))


def candidate_code(c: Column) -> Column:
    """struct<code, policy>: longest block tagged as C, else longest block of any tag, else the whole text.

    Blank blocks do not count; a blank text is empty.
    """
    text = strip(c)
    tagged = lambda tags: F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?is)```[ \\t]*(?:{tags})[ \\t]*\\r?\\n(.*?)```"), 1), strip), lambda b: b != "")
    c_blocks, blocks = tagged("c|h|cpp|c\\+\\+|cc|cxx|hpp"), tagged("[A-Za-z0-9_+.-]*")
    policy = F.when(text == "", "empty").when(F.size(c_blocks) > 0, "longest_c_fence").when(F.size(blocks) > 0, "longest_fence").otherwise("full_response")
    return F.struct(F.coalesce(first_longest(c_blocks), first_longest(blocks), text).alias("code"), policy.alias("policy"))


def last_fence(c: Column) -> Column:
    """The last fenced C block, else the stripped text."""
    blocks = fenced(c)
    return strip(F.when(F.size(blocks) > 0, F.try_element_at(blocks, F.lit(-1))).otherwise(F.coalesce(c, F.lit(""))))


def drop_answer_prefix(c: Column) -> Column:
    """Remove one leading ``Output:`` or ``Helpful Answer:``, then strip."""
    return strip(F.regexp_replace(c, r"^(?U:\s*)(?:Output|Helpful Answer)\s*:\s*", ""))


def rename_word(c: Column, old: Column, new: Column) -> Column:
    """struct<code, count>: whole-word replacement of one name by another."""
    pattern = F.concat(F.lit("(?U)\\b"), quoted(old), F.lit("\\b"))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return F.struct(F.regexp_replace(c, pattern, safe).alias("code"), F.regexp_count(c, pattern).alias("count"))


def rename_target(c: Column, name: Column, pattern: str = r"\b(?:FUN|sub)_[0-9A-Fa-f]+\b") -> Column:
    """Rename the first called placeholder function to ``name``; unchanged with count 0 if there is none."""
    old = F.regexp_extract(c, f"({pattern})\\s*\\(", 1)
    renamed = rename_word(c, old, name)
    skip = (old == "") | (old == name)
    return F.struct(F.when(skip, c).otherwise(renamed["code"]).alias("code"), F.when(skip, F.lit(0)).otherwise(renamed["count"]).alias("count"))


def rename_generated(c: Column, name: Column) -> Column:
    """Rename the function that the text defines first (last token before the first bracket) to ``name``."""
    head = F.split(strip(F.substring_index(c, "(", 1)), r"\s+")
    old = F.regexp_replace(F.coalesce(F.try_element_at(head, F.lit(-1)), F.lit("")), r"^\*+", "")
    fit = c.contains("(") & old.rlike(r"^[A-Za-z_]\w*$") & (old != name)
    renamed = rename_word(c, old, name)
    return F.struct(F.when(fit, renamed["code"]).otherwise(c).alias("code"), F.when(fit, renamed["count"]).otherwise(F.lit(0)).alias("count"))


#: Declarations that are prepended for scalar types a text uses and does not define, in this order.
COMPAT_TYPES = (
    ("undefined", "typedef unsigned char undefined;"),
    ("undefined1", "typedef unsigned char undefined1;"),
    ("undefined2", "typedef unsigned short undefined2;"),
    ("undefined4", "typedef unsigned int undefined4;"),
    ("undefined8", "typedef unsigned long long undefined8;"),
    ("undefined16", "typedef __uint128_t undefined16;"),
    ("byte", "typedef unsigned char byte;"),
)


def prepend_used(c: Column, definitions=COMPAT_TYPES) -> Column:
    """struct<code, added>: prepend the definition of each name that is used and not already typedef'd."""
    each = [F.when(c.rlike(rf"(?U)\b{re.escape(n)}\b") & ~c.rlike(rf"(?U)\btypedef\b[^;]*\b{re.escape(n)}\s*;"), F.lit(d)) for n, d in definitions]
    added = F.array_compact(F.array(*each))
    return F.struct(F.when(F.size(added) > 0, F.concat(F.array_join(added, "\n"), F.lit("\n\n"), c)).otherwise(c).alias("code"), F.size(added).alias("added"))


def sanitize_dependencies(c: Column, for_cpp: bool) -> Column:
    """Delete declarations that clash with a wrapper: orphan marks, printf prototypes and, for C++, boolean stand-ins."""
    if for_cpp:
        c = F.regexp_replace(c, r"(?m)^\s*typedef\s+int\s+bool\s*;.*$", "")
        c = F.regexp_replace(c, r"(?m)^\s*#define\s+(?:false|true)\s+[01]\s*$", "")
    c = F.regexp_replace(c, r"/\*<<<\s*orphan\s*\*/", "")
    return F.regexp_replace(c, r"(?m)^\s*int\s+printf\s*\([^;]*\)\s*;\s*$", "")


def externalize(c: Column, name: Column, keep_extern: bool = False) -> Column:
    """Remove linkage words before the first call or definition of ``name`` only; ``extern`` too unless it is to stay."""
    words = "static|inline|__inline|__inline__" + ("" if keep_extern else "|extern")
    head = F.regexp_substr(c, F.concat(F.lit("(?s)^.*?\\b(?="), quoted(name), F.lit("\\s*\\()")))
    cut = F.regexp_replace(head, rf"\b(?:{words})\b", "")
    return F.when(head.isNull(), c).otherwise(F.concat(cut, F.substr(c, F.length(head) + 1)))


def safe_name(c: Column) -> Column:
    """File-safe name: other characters become one underscore, dots and underscores at the ends go, default ``sample``."""
    name = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("sample"))


def body_lines(c: Column, least: int = 3) -> Column:
    """Lines of a trimmed length of ``least`` or more after the first opening brace."""
    body = F.substr(c, F.greatest(F.instr(c, F.lit("{")), F.lit(1)) + 1)
    return F.when(F.instr(c, F.lit("{")) == 0, 0).otherwise(F.size(F.filter(F.split(body, "\r\n|\n|\r"), lambda x: F.length(strip(x)) >= least)))


def squeeze(c: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def line_labels(c: Column) -> Column:
    """Sorted distinct ``I<n>`` labels of a line's comment."""
    comment = F.when(F.instr(c, F.lit("//")) > 0, F.substr(c, F.instr(c, F.lit("//")) + 2)).otherwise("")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(comment, F.lit(r"\bI(\d+)\b"), 1), lambda n: F.concat(F.lit("I"), n))))


def function_name(c: Column, fallback: Column) -> Column:
    """The first name that is followed by a bracketed list and an opening brace, else ``fallback``."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{", 1), F.lit("")), fallback)


def includes(c: Column) -> Column:
    """struct<includes, rest>: include lines apart from the other text."""
    return F.struct(F.array_join(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*#include[^\n]*$"), 0), "\n").alias("includes"), F.regexp_replace(c, r"(?m)^[ \t]*#include[^\n]*\n?", "").alias("rest"))


#: Fixed rules: what a candidate's source may not contain.
FORBIDDEN = (
    ("forbidden_preprocessor_directive", r"(?m)^\s*#\s*(include|include_next|pragma|line|embed)\b"),
    ("forbidden_system_or_process_call", r"\b(system|popen|fork|vfork|clone|exec[a-zA-Z0-9_]*|open|openat|creat|fopen|freopen|socket|socketpair|connect|bind|listen|accept|send|sendto|recv|recvfrom|dlopen|dlsym|ptrace|mount|umount|unshare|setns|chroot|pivot_root|kill|syscall)\s*\("),
    ("forbidden_inline_assembly_or_attribute", r"\b(__asm__|__asm|asm|_Pragma)\b|__attribute__\s*\(\([^)]*(constructor|destructor|section|alias)"),
    ("forbidden_path_literal", r'"(?:[^"\\]|\\.)*(?:/|\.\.)(?:[^"\\]|\\.)*"'),
)


def security_reasons(c: Column) -> Column:
    """Sorted reasons to refuse a candidate's source; empty if there is none."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in FORBIDDEN))))


#: Fixed rules: words of an error's class name and the reason code that they mean, first match first.
ERROR_REASONS = (
    (("authentication", "permission"), "closed_llm_auth_error"),
    (("ratelimit", "rate_limit"), "closed_llm_rate_limit"),
    (("timeout",), "closed_llm_timeout"),
    (("api", "connection", "badrequest", "notfound", "conflict", "unprocessable", "internalserver"), "closed_llm_api_error"),
)


def error_reason(c: Column) -> Column:
    """Reason code of an error's class name."""
    name, out = F.lower(c), None
    for parts, reason in ERROR_REASONS:
        hit = name.contains(parts[0])
        for p in parts[1:]:
            hit = hit | name.contains(p)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise("closed_llm_invalid_response")


def line_syntax(line: Column, requested: Column) -> Column:
    """``att`` or ``intel``: as requested, else by the register prefix."""
    asked = F.lower(requested)
    return F.when(asked.contains("att") | asked.contains("at&t"), "att").when(asked.contains("intel"), "intel").when(line.contains("%"), "att").otherwise("intel")


def view_syntax(view: Column) -> Column:
    """Syntax tag of a stored assembly view."""
    return F.when(F.lower(view).contains("att") | F.lower(view).isin("asm", "gcc"), "att").otherwise("intel")


def relocation_symbol(c: Column) -> Column:
    """A relocation's symbol without its negative addend."""
    return F.regexp_replace(c, r"-0x[0-9a-fA-F]+$", "")


def access_width(mnemonic: Column) -> Column:
    """Bytes that an instruction moves, by the last letter before a dot: b, w, l; else eight."""
    base = F.substring_index(mnemonic, ".", 1)
    return F.when(F.endswith(base, F.lit("b")), 1).when(F.endswith(base, F.lit("w")), 2).when(F.endswith(base, F.lit("l")), 4).otherwise(8)


def type_kind(c: Column, is_return: bool = False) -> Column:
    """Kind of a C type: void, pointer, unsupported_float, unsupported_aggregate or integer."""
    t = F.lower(F.regexp_replace(strip(c), r"\s+", " "))
    return (
        F.when(t == "void", "void")
        .when(t.rlike(r"[*\[]"), "object_pointer" if is_return else "pointer")
        .when(t.rlike("float|double|__m128|__m256"), "unsupported_float")
        .when(t.rlike("struct |union |class "), "unsupported_aggregate")
        .otherwise("integer")
    )


def tail(c: Column, n: int = 8000) -> Column:
    """The last ``n`` characters of a log."""
    return F.right(c, F.lit(n))


#: Type names of decompilers and what they are written as, applied in this order.
TYPE_NAMES = (
    ("cpu_set_t", "int"),
    ("nl_item", "int"),
    ("__time_t", "int"),
    ("__mode_t", "unsigned short"),
    ("__off64_t", "long long"),
    ("__blksize_t", "long"),
    ("__ino_t", "unsigned long"),
    ("__blkcnt_t", "unsigned long long"),
    ("__syscall_slong_t", "long"),
    ("__ssize_t", "long int"),
    ("wchar_t", "unsigned short int"),
    ("wctype_t", "unsigned short int"),
    ("__int64", "long long"),
    ("__int32", "int"),
    ("__int16", "short"),
    ("__int8", "char"),
    ("_QWORD", "uint64_t"),
    ("_OWORD", "long double"),
    ("_DWORD", "uint32_t"),
    ("size_t", "unsigned int"),
    ("_BYTE", "uint8_t"),
    ("_TBYTE", "uint16_t"),
    ("_BOOL8", "uint8_t"),
    ("gcc_va_list", "va_list"),
    ("_WORD", "unsigned short"),
    ("_BOOL4", "int"),
    ("__va_list_tag", "va_list"),
    ("_IO_FILE", "FILE"),
    ("DIR", "int"),
    ("__fsword_t", "long"),
    ("__kernel_ulong_t", "int"),
    ("cc_t", "int"),
    ("speed_t", "int"),
    ("fd_set", "int"),
    ("__suseconds_t", "int"),
    ("_UNKNOWN", "void"),
    ("__sighandler_t", "void (*)(int)"),
    ("__compar_fn_t", "int (*)(const void *, const void *)"),
)


def normalize_code(text: str | None) -> str | None:
    """One text for ``normalize_pseudocode``: comments and calling conventions out, hex to decimal, types by name."""
    if text is None:
        return None
    text = re.sub(r"//[^\n]*", "", re.sub(r"(?s)/\*.*?\*/", "", text))
    text = re.sub(r"\b0x([0-9a-fA-F]+)([uUlL]{1,3})?\b", lambda m: f"{int(m[1], 16)}{m[2] or ''}", text)
    text = re.sub(r"\b(?:__fastcall|__cdecl|__ptr32)\b|\b__noreturn\s+noreturn\b", "", text)
    for name, written in TYPE_NAMES:
        if name in text:
            text = re.sub(rf"\b{name}\b", lambda _, w=written: w, text)
    return text


@F.pandas_udf(T.StringType())
def normalize_pseudocode(c: pd.Series) -> pd.Series:
    """Normal form of decompiled code; hexadecimal numbers of any size need Python's integers."""
    return c.map(normalize_code)


def target_assembly(c: Column, name: Column) -> Column:
    """A function's part of compiler assembly: its visibility and type lines, then from its label to its size line; null without a label.

    Lines end with a newline; without a size line the part goes to the end.
    """
    q = quoted(name)
    label = F.concat(F.lit("(?m)^[ \\t]*"), q, F.lit(":[ \\t]*$"))
    at = F.regexp_instr(c, label)
    rest = F.substr(c, at)
    ends = F.concat(F.lit("(?m)^[ \\t]*\\.size\\s+"), q, F.lit("\\s*,[^\\n]*\\n?"))
    end = F.regexp_instr(rest, ends)
    body = F.when(end > 0, F.substr(rest, F.lit(1), end - 1 + F.length(F.regexp_substr(rest, ends)))).otherwise(rest)
    heads = F.regexp_extract_all(F.substr(c, F.lit(1), at - 1), F.concat(F.lit("(?m)^[ \\t]*\\.(?:globl|type)\\s+"), q, F.lit("(?:[ \\t,][^\\n]*)?\\n")), F.lit(0))
    return F.when(at > 0, F.concat(F.array_join(heads, ""), body))


def disassembly_header(c: Column, name: str = "candidate.o:") -> Column:
    """The first line that names the object's format, without the folder before ``name``."""
    return F.regexp_replace(c, f"(?s)\\A((?:(?!file format).)*?)(?-s)^?[^\\n]*{re.escape(name)}(?=[^\\n]*file format)", f"$1{name}")


#: Fixed patterns: how compilers name an identifier that is not declared.
UNDECLARED = (r"['\u2018\"`]([A-Za-z_$][A-Za-z0-9_$]*)['\u2019\"] (?:undeclared|was not declared)", r"use of undeclared identifier ['\u2018\"`]([A-Za-z_$][A-Za-z0-9_$]*)['\u2019\"]")


def undeclared(diagnostics: Column) -> Column:
    """Sorted distinct identifiers that a compiler calls undeclared."""
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(diagnostics, F.lit(p), F.lit(1)) for p in UNDECLARED))))


def public_declaration(declaration: Column, name: Column) -> Column:
    """A declaration that was published for a name, if it is one external declaration of it; else null."""
    d = strip(declaration)
    fits = F.regexp_like(d, F.concat(F.lit("^extern\\s+[^;{}]+\\b"), quoted(name), F.lit("\\s*;$"))) & name.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$")
    return F.when(fits, d)


#: Types that read-only data can be decoded as, their format letters and sizes.
NUMBERS = {"i8": "b", "u8": "B", "byte": "B", "i16": "h", "u16": "H", "word": "H", "i32": "i", "u32": "I", "dword": "I", "i64": "q", "u64": "Q", "qword": "Q", "f32": "f", "f64": "d"}


def decoded(data: str | None, base: int | None, address: int | None, label: str, kind: str) -> str:
    """JSON of the little-endian numbers at a label of read-only data, or what went wrong."""
    if address is None:
        return f"Not Found {label}!"
    m = re.fullmatch(r"(\w+?)(?:\[(\d+)\])?", (kind or "").lower().strip())
    try:
        form, n = f"<{NUMBERS[m[1]] * int(m[2] or 1)}", int(m[2] or 1)
        at = address - (base or 0)
        values = struct.unpack(form, bytes.fromhex(data or "")[at : at + struct.calcsize(form)])
        return json.dumps(values[0] if n == 1 else values)
    except (KeyError, TypeError, ValueError, struct.error):
        return f"Read {label} failed!"


@F.pandas_udf(T.StringType())
def decode_rodata(data: pd.Series, base: pd.Series, address: pd.Series, label: pd.Series, kind: pd.Series) -> pd.Series:
    """Numbers at labels of read-only data; unpacking typed bytes needs Python's struct."""
    whole = lambda v: None if v is None or pd.isna(v) else int(v)
    return pd.Series([decoded(d, whole(b), whole(a), n, k) for d, b, a, n, k in zip(data, base, address, label, kind, strict=True)])


PROCESSORS = {
    "markdown_fence": lambda code, name: (markdown_fence(code)["code"], F.size(fenced(code)) > 0),
    "rename_target": lambda code, name: (rename_target(code, name)["code"], rename_target(code, name)["count"] > 0),
    "compat_types": lambda code, name: (prepend_used(code)["code"], prepend_used(code)["added"] > 0),
}


def postprocess(df, code: str, name: str, steps: list[str], processors=PROCESSORS):
    """Apply named processors in order to column ``code``; ``actions`` lists those that changed something, the end is stripped."""
    df = df.withColumn("actions", F.array().cast("array<string>"))
    for step in steps:
        new, acted = processors[step](F.col(code), F.col(name))
        df = df.withColumn("_acted", acted).withColumn(code, new)
        df = df.withColumn("actions", F.when(F.col("_acted"), F.array_append("actions", F.lit(step))).otherwise(F.col("actions"))).drop("_acted")
    return df.withColumn(code, strip(F.col(code)))
