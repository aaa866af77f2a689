"""Credentials embedded in source code: finding and masking.

A text is scanned in layers. The outer layer is the text itself; every literal in it that
decodes from base64 (also when it is broken over lines), hex, percent or backslash escapes to
something readable is a further layer, scanned by the same rules, and so on until nothing
decodes: each layer is shorter than the one around it. Decoded bytes are also parsed as key
containers by their binary grammar (`container`), so a key without its text armour is found too.
A find in an inner layer masks the whole enclosing literal, since part of an encoded literal
cannot be replaced.

Rules look at assignments to secret names, at values whose own shape gives them away, and at the
places where protocols carry a secret (URLs, headers, connection strings, command lines, login
files, calls). Placeholders, references to variables or stores, public keys, certificates and
digests are left alone.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

_STRONG = (
    "password", "passwd", "passwort", "passphrase", "pass_phrase", "passcode", "pass", "pwd", "pw", "pin_code", "secret", "secret_key",
    "api_key", "apikey", "api_token", "access_token", "auth_token", "access_key", "auth_key", "client_secret", "signing_secret", "signing_key",
    "embed_key", "bot_token", "license_secret", "license_key", "licence_key", "license_code", "unlock_code", "unlock_key", "activation_key",
    "activation_code", "credential", "credentials", "contrasena", "contraseña", "mot_de_passe", "kennwort", "clave", "private_key", "session_key",
    "session_token", "encryption_key", "master_key", "shared_key", "account_key", "storage_key", "deploy_key", "refresh_token", "bearer_token",
)
_WEAK = ("token", "key", "session", "cookie", "auth", "jwt", "cred", "signature")
_NAME_TAIL = re.compile(r"(?:^|_)(?:(?P<strong>%s)|(?P<weak>%s))\d*$" % ("|".join(sorted(_STRONG, key=len, reverse=True)), "|".join(_WEAK)))
_NOT_SECRET = re.compile(r"(?:^|_)(?:public|pub|primary|foreign|sort|partition|cache|lookup|map|node|object)_key$")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

#: Keywords of the rules that do not go by a name: _URL, _CONN, _BEARER, _BASIC, _OPTION, _WORD, _LOGIN, _CALL, _QUERY.
_KEYWORDS = (
    "://", "pwd", "password", "accountkey", "sharedaccesskey", "bearer", "basic", "passwd", "pass", "token", "key", "secret", "passwort", "passphrase",
    *(verb + gap + "in" for verb in ("log", "logged", "sign", "signed") for gap in ("", " ", "-")), "session", "connect", "auth", "sign_in", "credential",
    "sig=", "signature=", "code=",
)


def _triggers() -> tuple[str, ...]:
    """What the rules look for, in lower case: their keywords, and the secret names with each border that
    name_strength takes for '_'. Words that contain another one are left out."""
    names = {"".join(p + g for p, g in zip(w.split("_"), [*gaps, ""], strict=True)) for w in _STRONG + _WEAK for gaps in itertools.product(("", "_", "-", "."), repeat=w.count("_"))}
    words = names | set(_KEYWORDS)
    return tuple(sorted(w for w in words if not any(x != w and x in w for x in words)))


#: A line can hold a plain secret only if its folded form has one of these.
TRIGGERS = _triggers()
#: Letters that a pattern without case takes for ASCII ones, though lower() keeps them.
_ALIKE = str.maketrans("\u017f\u0131\u0130", "sii")


def _folded(text: str) -> str:
    """The text in lower case, character for character, as patterns without case read it."""
    if text.isascii():
        return text.lower()
    text = text.translate(_ALIKE)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=65536)
def name_strength(name: str) -> int:
    """2 for names that hold a secret, 1 for names that may, 0 otherwise. Camel case, dots and
    dashes are word borders; names of environment variables (..._env) hold only a name."""
    flat = _HUMP.sub("_", name).lower().replace("-", "_").replace(".", "_").strip("_$")
    found = _NAME_TAIL.search(flat)
    if not found or _NOT_SECRET.search(flat):
        return 0
    return 2 if found["strong"] else 1


_PLACEHOLDER = re.compile(
    r"(?i)(?:change.?me|changeit|example.*|sample.*|todo.*|tbd|fixme|replace.?(?:me|with.*)|your[ _-].*|<.*>|\$\{.*\}?|\$\(.*|\{\{.*|%\(.*|%[a-z_]+%"
    r"|\$[a-z_]\w*|none|null|nil|undefined|true|false|redacted|\[redacted\]|dummy|placeholder|secret|password|passwd|test|x+|\*+|\.+|-+|_+"
    r"|(?:file|env|vault|ssm|op|keyring|kms|arn|secret|secrets|gopass|pass|ref)(?::|://).*|(?:os\.|process\.|system\.)?(?:getenv|environ|env)\b.*|@.*)"
)
_UPPER_NAME = re.compile(r"[A-Z][A-Z_]*")
_PLAIN_NUMBER = re.compile(r"[-+]?(?:0x[0-9a-fA-F]+|[\d.,_]+)[a-zA-Z%]{0,3}")


def is_secret(value: str, need: int = 1) -> bool:
    """Whether a value is written out and looks chosen or generated. need 1: quoted value of a
    secret name. need 2: a bare word, which must mix letters with digits or signs. need 3: value
    of a doubtful name, which must be long and mixed."""
    v = value.strip()
    if len(v) < (6 if need < 3 else 12) or _PLACEHOLDER.fullmatch(v) or _UPPER_NAME.fullmatch(v) or _PLAIN_NUMBER.fullmatch(v):
        return False
    if any(c.isspace() for c in v) or "${" in v or "{{" in v or "$(" in v:
        return False
    digit, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    sign = any(not c.isalnum() and c not in "_-./:" for c in v)
    if need == 1:
        return digit or (lower and upper) or sign
    if need == 2:
        return (digit or sign) and (lower or upper) and not re.fullmatch(r"[\w./-]*[/(].*[)]?|[a-z_]\w*\(.*", v)
    return digit and lower and (upper or len(v) >= 32) and not re.fullmatch(r"[\w-]+(?:/[\w-]+)+", v)


@dataclass(frozen=True)
class Find:
    """One secret: the span of its value in the text, and the rule that found it."""

    start: int
    end: int
    kind: str


_ASSIGN = re.compile(
    r"""(?P<name>[^\W\d][\w.$-]*)["'`\]]{0,3}(?:\s*:\s*&?(?:'\w+\s+)?\w+(?:<\w+>|\[\])?)?\s*(?:=>|:=|=|:|\bto\b)\s*[bru@]{0,2}(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)"""
)
_DEFINE = re.compile(r"""#\s*define\s+(?P<name>\w+)\s+(?P<q>["'])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)""")
_BARE = re.compile(r"""(?P<name>[^\W\d][\w.-]*)["'`\]]{0,2}\s*[=:]\s*(?P<v>[^\s"'`<>(){}\[\],;]{8,})""")
_OPEN = re.compile(r"""(?P<name>[^\W\d][\w.-]*)["'`\]]{0,3}(?:\s*:\s*&?\w+)?\s*[=:]\s*(?:[(\\\[]|[>|][-+]?)?\s*$""")
_NEXT = re.compile(r"""\s*(?:[bru]?(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)|(?P<bare>[^\s"'`;,()]{8,}))\s*[;,)+\\]*\s*$""")
_URL = re.compile(r"""\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://[^\s/:@"'`]{0,80}:(?P<v>[^\s/@"'`]{3,})@""")
_CONN = re.compile(r"""(?i)(?:^|[;"'`\s])(?:pwd|password|accountkey|sharedaccesskey)\s*=\s*(?P<v>[^;"'`\s]+)(?=[;"'`])""")
_BEARER = re.compile(r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9._~+/=-]{12,})")
_BASIC = re.compile(r"(?i)\bbasic\s+(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})")
_SSHPASS = re.compile(r"""\bsshpass\s+-p\s*(?P<q>["']?)(?P<v>\S+?)(?P=q)(?=\s|$)""")
_OPTION = re.compile(r"""(?i)(?<!\S)--?(?:password|passwd|pass|token|api-?key|secret|auth-token|access-key)(?:=|\s+)["']?(?P<v>[^\s"']{6,})""")
_WORD = re.compile(r"""(?i)\b(?:password|passwd|passwort|passphrase|pass|pwd)\s+(?P<q>["']?)(?P<v>[^\s"'=:]\S{5,}?)(?P=q)(?=\s|$)""")
_LOGIN = re.compile(r"(?i)\b(?:log(?:ged)?|sign(?:ed)?)[ -]?in\b[^\n]{0,40}?\b(?:was|is|as|with)\s+\S+\s+(?:/|with|and|:)\s+(?P<v>\S{6,})")
_PGPASS = re.compile(r"(?:^|[\s#/>*;-])[\w-]+(?:\.[\w-]+)+:\d{2,5}:[\w*-]+:[\w.-]+:(?P<v>\S{6,})")
_PORT = re.compile(r":\d{2,5}:")
_CALL = re.compile(r"""(?i)\b\w*(?:session|login|connect|auth|sign_?in|credential)\w*\s*=?\s*\((?:[^()\n"']*["'][^"'\n]*["']\s*,)+\s*(?P<q>["'])(?P<v>[^"'\n]{6,})(?P=q)\s*\)""")
_XML = re.compile(r"""(?i)\b(?:key|name)\s*=\s*"(?P<name>[^"]+)"\s+value\s*=\s*"(?P<v>[^"]*)\"""")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z][\w.-]*)>(?P<v>[^<>\s]{6,})</(?P=name)>")
_QUERY = re.compile(r"(?i)[?&](?:sig|signature|token|api_?key|access_token|secret|auth|code)=(?P<v>[A-Za-z0-9%_.~+/=-]{16,})")
_SHAPE = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|AIza[\w-]{35}"
    r"|[a-z]{2,6}_(?:live|prod|test|secret)_[A-Za-z0-9]{20,}|eyJ[\w-]{6,}\.eyJ[\w-]{6,}\.[\w-]{10,}"
    r"|[a-z]{2,5}[-_](?=[\w-]*[A-Z])(?=[\w-]*[a-z])(?=[\w-]*\d)[A-Za-z0-9_-]{32,})(?![A-Za-z0-9])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:\s|[>#/*\"'+\\nr])*[A-Za-z0-9+/=]{16,}|\s*(?:Proc-Type|DEK-Info|Version|Comment):")
_BODY_LINE = re.compile(r"\s*[>#/*\s\"']*[A-Za-z0-9+/=]{4,}[\"'+,;\s]*")
_LONG = re.compile(r"(?<![A-Za-z0-9_+/.%\\-])(?:[A-Za-z0-9_+/-]{20,}={0,2}|(?:[A-Za-z0-9_.~+/-]*%[0-9A-Fa-f]{2}){4,}[A-Za-z0-9_.~+/-]*|(?:[^\s\"'`\\]{0,40}\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3})){4,}[^\s\"'`\\]*)")

_SIMPLE = (
    (_URL, "url", 1, "://"), (_CONN, "connection", 1, "="), (_SSHPASS, "command", 1, "sshpass"), (_OPTION, "command", 2, "-"),
    (_WORD, "login", 2, "pass"), (_LOGIN, "login", 2, "in"), (_CALL, "call", 1, "("), (_QUERY, "signature", 1, "="), (_BEARER, "header", 2, "bearer"),
)


def _line_finds(line: str, base: int) -> Iterator[Find]:
    """Finds of one line of text that starts at `base`."""
    for rule, has in ((_ASSIGN, line), (_DEFINE, "define")):
        for m in rule.finditer(line) if has in line else ():
            strength = name_strength(m["name"])
            if strength and is_secret(m["v"], 1 if strength == 2 else 3):
                yield Find(base + m.start("v"), base + m.end("v"), "assignment")
    for m in _BARE.finditer(line):
        strength = name_strength(m["name"])
        if strength and is_secret(m["v"], 2 if strength == 2 else 3) and "://" not in m["v"]:
            yield Find(base + m.start("v"), base + m.end("v"), "assignment")
    low = _folded(line)
    for rule, kind, need, has in _SIMPLE:
        if has in low:
            for m in rule.finditer(line):
                if is_secret(m["v"], need):
                    yield Find(base + m.start("v"), base + m.end("v"), kind)
    for m in _BASIC.finditer(line) if "basic" in low else ():
        plain = _from_base64(m["v"])
        if plain and b":" in plain and is_secret(plain.decode("utf-8", "replace").split(":", 1)[1], 1):
            yield Find(base + m.start("v"), base + m.end("v"), "header")
    if "<" in line:
        for rule in (_XML, _ELEMENT):
            for m in rule.finditer(line):
                if name_strength(m["name"]) and is_secret(m["v"], 1):
                    yield Find(base + m.start("v"), base + m.end("v"), "markup")


def _continued(text: str, line: str, end: int) -> Iterator[Find]:
    """A secret name whose value stands on the following lines, as literals or folded text."""
    m = _OPEN.search(line)
    if not m or not name_strength(m["name"]):
        return
    first, at = True, end + 1
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        n = _NEXT.match(text[at:stop].rstrip("\r"))
        if not n:
            return
        group = "v" if n["q"] else "bare"
        if first and not is_secret(n[group], 1 if n["q"] and name_strength(m["name"]) == 2 else 2):
            return
        if not first and not n["q"]:
            return
        yield Find(at + n.start(group), at + n.end(group), "assignment" if first else "rest")
        first, at = False, stop + 1


def _private_keys(text: str) -> Iterator[Find]:
    """Private key blocks: the span from the BEGIN line to the END line. A BEGIN without key
    material after it is a mention; at the end of the text the block was cut off."""
    for m in _PEM.finditer(text):
        rest = text[m.end() : m.end() + 400].lstrip(" \t\r\n\\nr\"'+,;")
        if rest and not _BODY.match(rest):
            continue
        end = _PEM_END.search(text, m.end())
        stop = end.end() if end and not _PEM.search(text, m.end(), end.start()) else _body_end(text, m.end())
        yield Find(m.start(), stop, "private key")


def _body_end(text: str, at: int) -> int:
    """Where a key block without END line stops: after the last line that still is key material."""
    while at < len(text):
        nxt = text.find("\n", at + 1)
        nxt = len(text) if nxt < 0 else nxt
        line = text[at:nxt]
        if line.strip() and not _BODY_LINE.fullmatch(line):
            break
        at = nxt
    return at


def _from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int] | None:
    """(tag, content, end) of the DER element at `at`, or None if it does not fit."""
    if at + 2 > len(data):
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        count = length & 0x7F
        if not 0 < count <= 4 or at + count > len(data):
            return None
        length, at = int.from_bytes(data[at : at + count], "big"), at + count
    return (tag, data[at : at + length], at + length) if at + length <= len(data) else None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER elements that fill the data exactly, else None."""
    out, at = [], 0
    while at < len(data):
        item = _der(data, at)
        if not item:
            return None
        out.append((item[0], item[1]))
        at = item[2]
    return out


# DER contents of the object identifiers 1.2.840.113549.1.5 (password encryption), .1.12.1 (the same of PKCS#12) and .1.7 (enveloped data).
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_ENVELOPES = bytes.fromhex("2a864886f70d0107")
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _strings(data: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """`count` length-prefixed strings, and where they end."""
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out, at


def _openssh(data: bytes) -> str | None:
    """OpenSSH's container: cipher, key derivation and its options, public keys, private section. An
    unencrypted private section begins with the same number twice."""
    head = _strings(data, 15, 3)
    if not head or head[1] + 4 > len(data):
        return None
    (cipher, kdf, _), at = head
    count = int.from_bytes(data[at : at + 4], "big")
    body = _strings(data, at + 4, count + 1) if 0 < count <= 64 else None
    if not body or body[1] != len(data) or (cipher == b"none") != (kdf == b"none"):
        return None
    private = body[0][-1]
    if cipher != b"none":
        return "openssh encrypted"
    return "openssh" if len(private) >= 8 and private[:4] == private[4:8] else None


def container(data: bytes) -> str | None:
    """Which private key container the bytes are, by their grammar: openssh, pkcs1, dsa, sec1, pkcs8,
    pkcs8 encrypted or pkcs12; None for anything else, public keys and certificates included."""
    if data.startswith(b"openssh-key-v1\x00"):
        return _openssh(data)
    outer = _der(data)
    if not outer or outer[0] != _SEQUENCE or outer[2] != len(data):
        return None
    items = _elements(outer[1])
    if not items:
        return None
    kinds = [k for k, _ in items]
    version = items[0][1] if kinds[0] == _INTEGER else b""
    if kinds == [_INTEGER] * 9 and version in (b"\0", b"\1"):
        return "pkcs1"
    if kinds == [_INTEGER] * 6 and version == b"\0":
        return "dsa"
    if kinds[:2] == [_INTEGER, _OCTETS] and version == b"\1" and set(kinds[2:]) <= {0xA0, 0xA1}:
        return "sec1"
    inner = [_elements(c) if k == _SEQUENCE else None for k, c in items]
    first = lambda i: inner[i][0] if len(inner) > i and inner[i] else (0, b"")
    if kinds[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and version in (b"\0", b"\1") and first(1)[0] == _OID and set(kinds[3:]) <= {0xA0, 0xA1, 0x81}:
        return "pkcs8"
    if kinds == [_SEQUENCE, _OCTETS] and first(0)[0] == _OID and first(0)[1].startswith(_PASSWORD_SCHEMES):
        return "pkcs8 encrypted"
    if kinds[:2] == [_INTEGER, _SEQUENCE] and version == b"\3" and first(1)[0] == _OID and first(1)[1].startswith(_ENVELOPES):
        return "pkcs12"
    return None


# How image files begin.
_IMAGES = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"RIFF", b"BM", b"\0\0\1\0", b"<svg", b"<?xml")


def decoded(literal: str) -> Iterator[tuple[str, bytes]]:
    """(step, bytes): what a literal may stand for, one decoding step deeper."""
    if "%" in literal:
        plain = urllib.parse.unquote_to_bytes(literal)
        if plain != literal.encode():
            yield "percent", plain
    elif "\\" in literal:
        try:
            yield "escape", literal.encode("latin-1").decode("unicode_escape").encode("utf-8", "ignore")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return
    else:
        if len(literal) % 2 == 0 and _HEX.fullmatch(literal):
            yield "hex", bytes.fromhex(literal)
        if any(c.isdigit() for c in literal) or (any(c.isupper() for c in literal) and any(c.islower() for c in literal)):
            plain = _from_base64(literal)
            if plain:
                yield "base64", plain


_HEX = re.compile(r"[0-9a-fA-F]+")
#: Lines of one base64 literal: all but the last are full, and each may be quoted, joined or commented.
_WRAPPED = re.compile(r"(?m)^(?:[ \t>#/*\"'(+]*[A-Za-z0-9+/_-]{40,}[\"' \t+,;)\\]*\r?\n)+[ \t>#/*\"'(+]*[A-Za-z0-9+/_-]{2,}={0,2}(?=[\"' \t+,;)\\]*\r?$)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{2,}={0,2}")


def _readable(data: bytes) -> str | None:
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 6 and all(c.isprintable() or c in "\r\n\t" for c in s) else None


@dataclass(frozen=True)
class Layer:
    """A literal that decodes: its spans (one a line), the decoding steps down to the innermost layer
    that holds something, and what that is: a container's kind, 'secret' or 'text'."""

    spans: tuple[tuple[int, int], ...]
    steps: tuple[str, ...]
    holds: str


def _opened(literal: str, inline_data: bool) -> tuple[tuple[str, ...], str] | None:
    """(steps, holds) of a literal: the first reading that holds a key or a secret, else a readable one."""
    plain_reading = None
    for step, plain in decoded(literal):
        if inline_data and plain.startswith(_IMAGES):
            continue
        kind = container(plain) if len(plain) >= 40 else None
        if kind:
            return (step,), kind
        inner = _readable(plain)
        if not inner or len(inner) >= len(literal):
            continue
        below = [x for x in layers(inner) if x.holds != "text"]
        if below:
            return (step, *below[0].steps), below[0].holds
        if finds(inner):
            return (step,), "secret"
        plain_reading = plain_reading or ((step,), "text")
    return plain_reading


def layers(text: str) -> list[Layer]:
    """All literals of a text that decode to something readable or to a key container, by position."""
    out, wrapped = [], []
    for m in _WRAPPED.finditer(text) if text.count("\n") else ():
        runs = [(r.start(), r.end()) for r in _RUN.finditer(text, m.start(), m.end())]
        got = _opened("".join(text[a:b] for a, b in runs), False)
        if got:
            out.append(Layer(tuple(runs), *got))
            wrapped.append(m.span())
    for m in _LONG.finditer(text):
        if any(a <= m.start() < b for a, b in wrapped):
            continue
        inline = text[max(0, m.start() - 7) : m.start()] == "base64," and text.rfind("data:", max(0, m.start() - 60), m.start()) >= 0
        got = _opened(m.group(), inline)
        if got:
            out.append(Layer((m.span(),), *got))
    return out


def _long_literals(text: str) -> Iterator[Find]:
    """Unbroken literals: values whose shape gives them away, and encoded ones that hide a secret
    or a key container. Of one broken over lines the first line is the find, the others its rest."""
    for t in _SHAPE.finditer(text):
        yield Find(t.start(), t.end(), "token")
    for layer in layers(text):
        if layer.holds != "text":
            for i, (a, b) in enumerate(layer.spans):
                yield Find(a, b, "rest" if i else "encoded" if layer.holds == "secret" else "encoded key")


def finds(text: str) -> list[Find]:
    """All secrets of a text, by position; overlapping finds are merged into the first."""
    low = _folded(text)
    starts: set[int] = set()
    for word in TRIGGERS:
        i = low.find(word)
        while i >= 0:
            starts.add(text.rfind("\n", 0, i) + 1)
            end = text.find("\n", i)
            i = low.find(word, end) if end >= 0 else -1
    out: list[Find] = []
    for a in starts:
        end = text.find("\n", a)
        end = len(text) if end < 0 else end
        line = text[a:end].rstrip("\r")
        out.extend(_line_finds(line, a))
        out.extend(_continued(text, line, end))
    if "PRIVATE KEY" in text:
        out.extend(_private_keys(text))
    keys = [f for f in out if f.kind == "private key"]
    if _PORT.search(text):
        out.extend(Find(m.start("v"), m.end("v"), "login") for m in _PGPASS.finditer(text) if is_secret(m["v"], 2))
    out.extend(f for f in _long_literals(text) if not any(k.start <= f.start < k.end for k in keys))
    merged: list[Find] = []
    for f in sorted(out, key=lambda f: (f.start, -f.end)):
        if merged and f.start < merged[-1].end:
            last = merged[-1]
            if f.end > last.end:
                merged[-1] = Find(last.start, f.end, last.kind)
        else:
            merged.append(f)
    return merged


def masked(text: str, found: list[Find]) -> str:
    """The text with every find masked and everything else as it was. Line feeds inside a find
    stay, so the numbers of the lines do; of a key block the BEGIN and END lines stay too."""
    out, at = [], 0
    for f in found:
        value = text[f.start : f.end]
        out.append(text[at : f.start])
        if f.kind == "private key":
            lines = value.split("\n")
            last = len(lines) - 1 if len(lines) > 1 and _PEM_END.search(lines[-1]) else len(lines)
            if len(lines) == 1:
                lines[0] = _PEM.search(value).group() + MASK
            lines[1:last] = [MASK + ("\r" if x.endswith("\r") else "") for x in lines[1:last]]
            out.append("\n".join(lines))
        else:
            out.append(MASK)
        at = f.end
    return "".join([*out, text[at:]])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_kind, record_id, text) to (record_kind, record_id, line_no, kind): one row a find."""
    for batch in batches:
        kinds, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for kind, key, text in zip(kinds, ids, texts, strict=True):
            line, at = 1, 0
            for f in finds(text):
                if f.kind == "rest":
                    continue
                line, at = line + text.count("\n", at, f.start), f.start
                rows.append((kind, key, line, f.kind))
        yield _batch(rows, ["record_kind", "record_id", "line_no", "kind"], [pa.string(), pa.int64(), pa.int32(), pa.string()])


def open_layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_kind, record_id, text) to (record_kind, record_id, line_no, layers, holds): a row a
    literal that decodes."""
    for batch in batches:
        rows = []
        for kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for x in layers(text):
                rows.append((kind, key, 1 + text.count("\n", 0, x.spans[0][0]), ">".join(x.steps), x.holds))
        yield _batch(rows, ["record_kind", "record_id", "line_no", "layers", "holds"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()])


def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_kind, record_id, text) to the masked records that had a find, with new lengths."""
    try:
        import zstandard

        packed = lambda raw: len(zstandard.ZstdCompressor(level=9).compress(raw))
    except ImportError:
        packed = lambda raw: None
    for batch in batches:
        rows = []
        for kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = finds(text)
            if found:
                clean = masked(text, found)
                raw = clean.encode("utf-8")
                rows.append((kind, key, sum(f.kind != "rest" for f in found), len(raw), packed(raw), clean))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield _batch(rows, ["record_kind", "record_id", "secrets", "uncompressed_len", "payload_len", "text"], kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def code_records(patches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) of both tables; null texts and ids are left out."""
    one = patches.select(F.lit("patch").alias("record_kind"), F.col("patch_id").alias("record_id"), F.col("content").alias("text"))
    two = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), "text")
    return one.unionByName(two).dropna()


def find_credentials(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no): a row for each line on which a secret begins. The scan is
    a narrow map over the rows; only the finds are made distinct, so repeated rows count once."""
    found = records.mapInArrow(scan, "record_kind string, record_id long, line_no int, kind string")
    return found.select("record_kind", "record_id", "line_no").distinct()


def decoded_layers(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no, layers, holds, literals): the named method over all records. For
    each line the literals that begin on it and decode: the steps down to the innermost layer that
    holds something, what it holds (a key container's kind, 'secret', or plain 'text'), and how
    many literals of the line are alike. Repeated records count once."""
    found = records.distinct().mapInArrow(open_layers, "record_kind string, record_id long, line_no int, layers string, holds string")
    return found.groupBy("record_kind", "record_id", "line_no", "layers", "holds").agg(F.count(F.lit(1)).alias("literals"))


def redact(records: DataFrame) -> DataFrame:
    """Records that had a secret, masked, with their number of secrets and new lengths
    (payload_len: zstd level 9). Repeated rows give one row."""
    out = "record_kind string, record_id long, secrets int, uncompressed_len int, payload_len long, text string"
    return records.mapInArrow(mask, out).dropDuplicates(["record_kind", "record_id"])
