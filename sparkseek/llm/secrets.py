"""p1: credentials in source code, found through every layer of encoding and masked in place.

A chunk is searched for (a) values whose form alone gives them away (vendor tokens, signed web tokens, private keys, passwords
in URLs), (b) literals given to a name, argument, option, header or sentence that says it is a secret, and (c) random values in
files whose path says that they hold secrets. Literals put together from parts, or wrapped over lines, are read as one. Every
literal that may be base64, hex, percent-encoded or escaped is decoded, whatever its length, and what comes out is searched again
until nothing decodes any more: each layer is shorter than the one around it, so this ends, in time linear in the literal. Binary
results are parsed by their grammars as key containers (PKCS#1, PKCS#8 plain and encrypted, SEC 1, DSA, PKCS#12, OpenSSH, Java key
stores). A finding inside an encoded literal counts for the enclosing literal, which is masked as a whole.

Masking replaces each character of the value by ``*``; quotes, armour lines, escapes and line ends stay, so the code keeps its
length, lines and syntax.

Defined cases
    null and empty code holds nothing; repeated rows count once; the same chunk id with different code is searched in each; a null
    path only switches (c) off; several findings on one line give one row; very long lines are searched whole; line ends
    inside a chunk are ``\\n`` (a CR before them belongs to the line); other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Published forms of vendor tokens (fixed values).
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{30,}|glpat-[\w-]{16,}|[sr]k_live_[A-Za-z0-9]{16,}|(?:AKIA|ASIA)[A-Z0-9]{12,}"
    r"|AIza[\w-]{30,}|xox[abeoprs]-[A-Za-z0-9-]{20,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z]{30,}|pypi-[\w-]{40,}|sq0[a-z]{3}-[\w-]{22,}|ya29\.[\w-]{20,}"
    r")"
)
_TOKEN_STARTS = ("gh", "glpat-", "k_live_", "AKIA", "ASIA", "AIza", "xox", "npm_", "SG.", "eyJ", "dop_v1_", "hf_", "pypi-", "sq0", "ya29.")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What a key's body holds, also inside literals, up to where it ends without an end line.
KEY_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s\"'+,]|\\[nr])*")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PPK = re.compile(r"^PuTTY-User-Key-File-\d:.*?^Private-Lines:[ \t]*(\d+)[ \t]*\r?\n", re.M | re.S)
JWK = re.compile(r"\{[^{}]*[\"']kty[\"'][^{}]*\}")
JWK_PRIVATE = re.compile(r"[\"'](?:d|k)[\"']\s*:\s*[\"']([A-Za-z0-9_-]{16,})[\"']")
URL_LOGIN = re.compile(r"(?<![a-zA-Z0-9+.-])[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`]+)@")

#: Words a secret's name ends in, and the words that may still follow (fixed vocabulary).
_SECRET_END = r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|secrets?|token|api[_-]?key|credentials?|private[_-]?key|(?:signing|access|secret|encryption|master|service|auth|shared|deploy|ssh|license|account|storage)[_-]?key|auth(?:orization|entication)?|identity|signing|pem|login|passwort|kennwort|contraseña|clave|密码|密钥|口令)"
_SECRET_TAIL = r"(?:[_-]?(?:b64|base64|enc(?:oded)?|hex|raw|plain|value|val|str|string|blob|header|current|old|new|prod|live|default|key|\d+))*"
SECRET_NAME = re.compile(rf"(?:^|[_\W]|(?<=[a-z0-9])(?=[A-Z]))(?:encoded[_-]?)?{_SECRET_END}{_SECRET_TAIL}$", re.I)
_KEY_ONLY = re.compile(r"^(?:KEY|key)$")
#: Names of things that only look random (fixed vocabulary).
HARMLESS_NAME = re.compile(r"(?:^|_)(?:digest|hash|sha\d*|md5|checksum|etag|commit|revision|integrity|fingerprint|uuid|guid|id|icon|logo|pixel|image|cert(?:ificate)?|public_?key|nonce|version|label|help|hint|placeholder|message|title|text|url|uri|name|path|file)\d*$", re.I)

_STR = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
STRING = re.compile(_STR)
#: Where two literals are one: an operator or only space between them, or a line that goes on.
_JOIN = re.compile(r"([\"'`])\s*(?:\+|\.\.?|\|\||&|\\\r?\n)?\s*\1|\\\r?\n[ \t]*")
#: name (:= | = | : | => | ,) "literal"
NAMED = re.compile(rf"(?<![\w$.\-])([\w$.\-]*[\w$\-])[\"'`]?\]?\s*(?::\s*[\w.\[\]<>| ]+?\s*)?(?::=|=>|=(?!=)|:|,)\s*(?:[brufBRUF]{{1,2}}(?=[\"']))?({_STR})")
BARE = re.compile(r"^\s*(?:export\s+|set\s+|-\s+|ENV\s+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*[:=]\s*([^\s\"'`{\[(<$#][^\s\"'`]*)\s*(?:#.*)?\r?$")
DEFINE = re.compile(rf"^\s*#\s*define\s+(\w+)\s+({_STR})")
LOGIN_CALL = re.compile(rf"\b\w*(?:login|log_in|sign_?in|authenticate|basic_?auth|set_?credentials)\s*\(\s*{_STR}\s*,\s*({_STR})", re.I)
HEADER = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9+/_.~=-]{8,})", re.I)
PAIR = re.compile(r"(?:^|[;&?\s,{(<\"'])([\"']?)([\w-]*(?:pass(?:word|wd)?|pwd|secret|token|api_?key|auth)[\w-]*)\1\s*[=:]\s*([\"']?)([^\s;&\"',}>)]{6,})", re.I)
OPTION = re.compile(r"(?:^|\s)--?(?:pass(?:word|wd)?|pwd|secret|token|api-?key|auth)[ =]([^\s\"'`]{6,})", re.I)
USER_OPTION = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[\w.@-]+:([^\s\"'`]{6,})")
SENTENCE = re.compile(r"\b(?:pass(?:word|wd|phrase)?|pwd|pw|login|secret|token|key|credentials?)\b(?:\s+(?:was|is|used to be|still|now))*\s*[:=]?\s+[\"'`]?([^\s\"'`,;]{8,})", re.I)
SQL_LOGIN = re.compile(rf"\b(?:IDENTIFIED\s+BY|PASSWORD)\s+({_STR})", re.I)
COMMENT = re.compile(r"(?:^|\s)(?://|#|--|/?\*|;|<!--|%)\s")

_PLACEHOLDER = re.compile(
    r"^(?:[x*.#_\-•]+|.*(?:your|insert|replace|change|example|placeholder|redacted|dummy|<[^>]*>|\$\{|\$\(|\{\{|%\(|%s|\{\}).*|(?:change_?me|todo|none|null|nil|true|false|undefined|password|passwort|secret|token|test|env:.*|process\.env.*|os\.environ.*|vault:.*|\$[A-Z_]+|file:.*|ref:.*|arn:.*|secretref.*|op://.*))$",
    re.I,
)
_HASHED = re.compile(r"^(?:\$(?:2[abxy]|5|6|argon2\w*|scrypt|pbkdf2\S*)\$|\{?(?:ssha|sha\d*|md5|bcrypt|pbkdf2)[}:$-]|sha\d+-)", re.I)
_IMAGE = re.compile(r"data:[\w.+-]+/[\w.+-]+;base64,", re.I)
_FILE_HARMLESS = re.compile(r"example|template|mock|dummy|demo|\.(?:sample|dist)$", re.I)
_PATH_DIRECTORY = re.compile(r"(?:^|/)(?:secrets?|credentials?)/[^/]*$|(?:^|/)(?:prod|live|production|staging|private|real)[_.-]?(?:secrets?|credentials?)", re.I)
_PLAIN_FILE = re.compile(r"\.(?:ya?ml|properties|toml|env|ini|cfg|conf|cnf|txt|md|sh|bash|netrc)$|(?:^|/)(?:Dockerfile|\.env[\w.]*|\.netrc|credentials)$", re.I)
_RANDOM = re.compile(r"^[A-Za-z0-9+/_=-]{20,}$")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A literal wrapped over lines, or with escaped line ends.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:(?:\\[nr]|[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]{4,})+={0,2}")
_GAP = re.compile(r"\\[nr]|\s")
_PERCENT = re.compile(r"(?<![\w.~%-])(?:[\w.~-]*%[0-9A-Fa-f]{2}){3,}[\w.~%-]*")
_ESCAPED = re.compile(r"(?:[\w+/=.:-]?\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}){4,}[\w+/=]*")
_TRIGGERS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "login", "signin", "sign_in", "identity", "signing", "pem", "bearer", "basic ", "identified", "-u ", "--user", "kennwort", "clave", "contrase", "密码", "密钥", "口令")


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """True for values that stand for a secret: templates, references, masks, samples and repeated characters."""
    tail = re.split(r"[_-]", value)[-1]
    return bool(_PLACEHOLDER.match(value)) or (len(tail) >= 8 and len(set(tail)) <= 2) or len(set(value)) <= 3 or bool(re.search(r"([xX*0])\1{5,}|\{[\w.\[\]]+\}", value))


def strong(value: str, sure: bool = False) -> bool:
    """True for values that can be a password or key: not a label, a message, words joined by hyphens, or a hash.

    ``sure``: the place itself is one for passwords, so mixed letters suffice.
    """
    if len(value) < 6 or any(c.isspace() for c in value) or placeholder(value) or _HASHED.match(value) or _IMAGE.match(value):
        return False
    if value.startswith(("http://", "https://", "/", "./", "../", "@")) or "://" in value:
        return False
    classes = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^\w\s.-]", value))
    if not re.search(r"\d", value) and not re.search(r"[^\w\s.\-/:]", value):
        if sure and re.search(r"[a-z][A-Z]", value) and len(value) >= 8:
            return True
        # letters only: a name unless it is long and mixed like random text
        return len(value) >= 16 and classes >= 2 and entropy(value) > 3.6 and not re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*", value) or (len(value) >= 24 and entropy(value) > 4)
    return classes >= 2 or len(value) >= 12


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly; None if they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


#: Object identifiers, as bytes: password-based encryption (PKCS#5, PKCS#12), and the content types of a PKCS#12 store (fixed values).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_CONTENT = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))


def der_private_key(data: bytes) -> bool:
    """True if the bytes are a private key or key store by the whole grammar of PKCS#1, PKCS#8, EncryptedPrivateKeyInfo, SEC 1, DSA
    or PKCS#12."""
    if data[:1] != b"\x30":
        return False
    outer = elements(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    parts = elements(data, outer[0][1], outer[0][2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]

    def inner(i: int) -> list[tuple[int, int, int]]:
        return elements(data, parts[i][1], parts[i][2]) or []

    def identifier(i: int) -> bytes:
        own = inner(i)
        return data[own[0][1] : own[0][2]] if own and own[0][0] == 0x06 else b""

    if tags == [0x30, 0x04]:
        return identifier(0).startswith(_PBE) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    number = data[parts[0][1]]
    whole = all(t == 0x02 and b > a for t, a, b in parts)
    if number in (0, 1) and whole and len(parts) in (6, 9):
        return True  # DSA, PKCS#1
    if number == 1 and tags[:9] == [0x02] * 9 and tags[9:] == [0x30]:
        return True  # PKCS#1 of several primes
    if number in (0, 1) and tags[1:3] == [0x30, 0x04]:
        return bool(identifier(1)) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    if number == 1 and tags[1] == 0x04:
        return parts[1][2] - parts[1][1] >= 20 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return number == 3 and tags[1] == 0x30 and tags[2:] in ([], [0x30]) and identifier(1) in _CONTENT


def openssh_key(data: bytes) -> bool:
    """True if the bytes are an OpenSSH key container, every field read by its length to the end."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at, fields = 15, []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        fields.append(field())
    if None in fields or not re.fullmatch(rb"[\w@.-]+", fields[0]) or not re.fullmatch(rb"[\w@.-]+", fields[1]):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 1_000 or any(field() is None for _ in range(keys)):
        return False
    private = field()
    return bool(private) and at == len(data) and (fields[0] != b"none" or private[:4] == private[4:8])


def java_store(data: bytes) -> bool:
    """True if the bytes are a Java key store whose first entry is a private key."""
    return data[:4] == b"\xfe\xed\xfe\xed" and int.from_bytes(data[4:8], "big") in (1, 2) and len(data) > 16 and data[8:12] != b"\0\0\0\0" and data[12:16] == b"\0\0\0\1"


def key_container(data: bytes) -> bool:
    return der_private_key(data) or openssh_key(data) or java_store(data)


def decodings(literal: str) -> Iterator[bytes]:
    """What a literal gives as hex, base64, percent-encoded or escaped text."""
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){8,}", literal):
        yield bytes.fromhex(literal)
    if re.fullmatch(r"[A-Za-z0-9+/_-]{12,}={0,2}", literal):
        body = literal.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 != 1:
            try:
                yield base64.b64decode(body + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                pass
    if "%" in literal and re.search(r"%[0-9A-Fa-f]{2}", literal):
        yield unquote_to_bytes(literal)
    if "\\" in literal and _ESCAPED.search(literal):
        try:
            yield literal.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "ignore")
        except (UnicodeDecodeError, ValueError):
            pass


def readable(data: bytes) -> str | None:
    """The bytes as text if they are printable; text of two bytes a sign is read too."""
    if len(data) < 6:
        return None
    if len(data) % 2 == 0 and data[1] == 0 and not any(data[1::2]):
        data = data[::2]
    if data[0] >= 0x80 or (len(data) > 64 and max(data[:64]) >= 0xF5):
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or all(c.isprintable() or c in "\r\n\t" for c in text) else None


def literals(text: str) -> Iterator[tuple[int, int]]:
    """Spans of what may be encoded in a text: runs, runs wrapped over lines, percent-encoded and escaped stretches."""
    for m in _WRAPPED.finditer(text):
        yield m.span()
    for m in _ENCODED.finditer(text):
        yield m.span()
    if "%" in text:
        for m in _PERCENT.finditer(text):
            yield m.span()
    if "\\" in text:
        for m in _ESCAPED.finditer(text):
            yield m.span()


def layers(literal: str) -> Iterator[bytes]:
    """What a literal gives when decoded, and what the literals in that give, layer by layer. Every layer is shorter than the one
    around it, so there is no bound on their number."""
    todo = [_GAP.sub("", literal)]
    while todo:
        for data in decodings(todo.pop()):
            yield data
            text = readable(data)
            if text:
                todo += [_GAP.sub("", text[a:b]) for a, b in literals(text)]


def encoded_secret(literal: str) -> bool:
    """True if a literal hides a key container, or a text of telling form, under one or more encodings."""
    if len(literal) < 12:
        return False
    for data in layers(literal):
        if key_container(data):
            return True
        text = readable(data)
        if text and text != literal and telling(text):
            return True
    return False


def telling(text: str) -> bool:
    """True if a decoded text is itself evidence: a token, private key, login URL, or a named strong value."""
    if any(s in text for s in _TOKEN_STARTS) and any(not placeholder(m.group()) for m in TOKEN.finditer(text)):
        return True
    if KEY_BEGIN.search(text) or PPK.search(text) or any(JWK_PRIVATE.search(m.group()) for m in JWK.finditer(text)) or any(not placeholder(m.group(1)) for m in URL_LOGIN.finditer(text)):
        return True
    return any(SECRET_NAME.search(m.group(2)) and strong(m.group(4)) for m in PAIR.finditer(text)) or any(SECRET_NAME.search(m.group(1)) and strong(m.group(2)[1:-1]) for m in NAMED.finditer(text))


def _name(raw: str) -> str:
    return raw.strip("\"'`").replace("-", "_").split(".")[-1]


def _value(literal: str) -> str:
    return "".join(s[1:-1] for s in STRING.findall(literal))


def named_secret(name: str, value: str) -> bool:
    """True if a name says that a value is a secret and the value can be one."""
    name = _name(name)
    if HARMLESS_NAME.search(name) or not (SECRET_NAME.search(name) or _KEY_ONLY.match(name)):
        return False
    header = HEADER.fullmatch(value)
    if header:
        return basic_or_bearer(header)
    if _PUBLIC.search(value) or KEY_BEGIN.search(value):
        return False
    return strong(value) or any(text and strong(text) for text in map(readable, layers(value)))


_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)|^ssh-(?:rsa|ed25519) ")


def basic_or_bearer(found: re.Match) -> bool:
    """True if an authorization value holds a login or token."""
    kind, value = found.group(1).lower(), found.group(2)
    if placeholder(value):
        return False
    if kind == "basic":
        text = next((t for t in map(readable, decodings(value)) if t), "")
        return ":" in text and not placeholder(text.split(":", 1)[1])
    return strong(value) or bool(TOKEN.fullmatch(value))


def _line(line: str, path_tells: bool, plain: bool) -> Iterator[tuple[int, int]]:
    """Spans of the secrets of one line, by names and notations. ``plain``: values need no quotes in this kind of file."""
    plain = plain or line.lstrip().startswith(("export ", "ENV "))
    for m in NAMED.finditer(line):
        value = _value(m.group(2))
        if named_secret(m.group(1), value) or (path_tells and random_value(m.group(1), value)):
            yield m.span(2)
    m = DEFINE.match(line)
    if m and named_secret(m.group(1), _value(m.group(2))):
        yield m.span(2)
    m = BARE.match(line) if plain else None
    if m and (named_secret(m.group(1), m.group(2)) or (path_tells and random_value(m.group(1), m.group(2)))):
        yield m.span(2)
    for m in LOGIN_CALL.finditer(line):
        if strong(_value(m.group(1)), sure=True):
            yield m.span(1)
    for m in SQL_LOGIN.finditer(line):
        if strong(_value(m.group(1))):
            yield m.span(1)
    for m in HEADER.finditer(line):
        if basic_or_bearer(m):
            yield m.span(2)
    strings = [] if plain else [t.span() for t in STRING.finditer(line)]
    for m in PAIR.finditer(line):
        if (plain or any(a < m.start(2) and m.end(4) < b for a, b in strings)) and SECRET_NAME.search(_name(m.group(2))) and not HARMLESS_NAME.search(_name(m.group(2))) and strong(m.group(4)) and not re.match(r"[\w.]+\(|\w+\.\w+$|\w+\[", m.group(4)):
            yield m.span(4)
    for rule in (OPTION, USER_OPTION):
        for m in rule.finditer(line):
            if strong(m.group(1), sure=True):
                yield m.span(1)
    c = COMMENT.search(line) or re.match(r"", line) if not STRING.search(line) else COMMENT.search(line)
    if c:
        for m in SENTENCE.finditer(line, c.start()):
            value = m.group(1)
            if strong(value) and re.search(r"\d", value) and not re.search(r"[()\[\]{}=]|^[\w]+\.\w+$|^\w+:$", value):
                yield m.span(1)


def random_value(name: str, value: str) -> bool:
    """True for a value that can only be random, under a name that does not explain it."""
    return bool(_RANDOM.match(value)) and not HARMLESS_NAME.search(_name(name)) and not placeholder(value) and entropy(value) > 3.5 and bool(re.search(r"\d", value)) and bool(re.search("[a-z]", value)) and bool(re.search("[A-Z]", value))


def path_tells(path: str | None) -> bool:
    """True if a path says that the file holds live secrets, not examples of them."""
    return bool(path) and bool(_PATH_DIRECTORY.search(path)) and not _FILE_HARMLESS.search(path.rsplit("/", 1)[-1]) and not re.search(r"(?:^|/)(?:examples?|samples?|fixtures?|snapshots?|mocks?|templates?)/", path)


def find(code: str, path: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the secrets of a chunk, in order of their start; overlapping ones are joined."""
    spans: list[tuple[int, int]] = []
    # (a) telling forms, wherever they stand; parts joined by + are read as one
    text, at = _unjoin(code)
    place = lambda a, b: (at(a), at(max(a, b - 1)) + 1)
    images = [m.span() for m in _IMAGE_DATA.finditer(text)] if "base64," in text or "sha" in text else []
    if any(s in text for s in _TOKEN_STARTS):
        for m in TOKEN.finditer(text):
            if not placeholder(m.group()) and not _within(images, m.start()):
                spans.append(place(*m.span()))
    if "PRIVATE KEY" in text:
        for m in KEY_BEGIN.finditer(text):
            end = KEY_END.search(text, m.end())
            last = end.end() if end else KEY_BODY.match(text, m.end()).end()
            body = text[m.end() : end.start() if end else last]
            if re.search(r"[A-Za-z0-9+/]{16,}", body) or not body.strip():
                spans.append(place(m.start(), last))
    if "Private-Lines" in text:
        for m in PPK.finditer(text):
            last = m.end()
            for _ in range(int(m.group(1)[:6])):
                last = text.find("\n", last) + 1 or len(text)
            spans.append(place(m.end(), len(text[:last].rstrip())))
    if "kty" in text:
        spans += [place(m.start() + d.start(1), m.start() + d.end(1)) for m in JWK.finditer(text) for d in [JWK_PRIVATE.search(m.group())] if d]
    if "://" in text:
        for m in URL_LOGIN.finditer(text):
            if not placeholder(m.group(1)):
                spans.append(place(*m.span(1)))
    # encoded literals; one that lies in an encoded literal found before is not decoded again
    done = 0
    for a, b in sorted(set(literals(text)), key=lambda x: (x[0], -x[1])):
        if b > done and not _within(images, a) and encoded_secret(text[a:b]):
            spans.append(place(a, b))
            done = b
    # (b), (c) names and notations, on the lines that mention any
    tells, plain = path_tells(path), bool(_PLAIN_FILE.search(path or ""))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if tells or any(t in low for t in _TRIGGERS):
        start = 0
        for line in text.split("\n"):
            if len(line) > 5 and (tells or any(t in low[start : start + len(line)] for t in _TRIGGERS)):
                spans += [place(start + a, start + b) for a, b in _line(line, tells, plain)]
            start += len(line) + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_IMAGE_DATA = re.compile(r"(?:data:[\w.+-]+/[\w.+-]+;base64,|sha\d+-)[A-Za-z0-9+/=]*", re.I)


def _within(spans: list[tuple[int, int]], at: int) -> bool:
    """True if a place stands in one of the spans, which are in order."""
    i = bisect.bisect_right(spans, (at, sys.maxsize)) - 1
    return i >= 0 and at < spans[i][1]


def _unjoin(code: str):
    """The code with the parts of literals made one, and the place of each of its characters in the code."""
    if not _JOIN.search(code):
        return code, lambda i: i
    parts, moves, last, gone = [], [(0, 0)], 0, 0
    for m in _JOIN.finditer(code):
        parts.append(code[last : m.start()])
        gone += m.end() - m.start()
        moves.append((m.end() - gone, gone))
        last = m.end()
    parts.append(code[last:])
    starts = [s for s, _ in moves]

    def at(i: int) -> int:
        return i + moves[bisect.bisect_right(starts, i) - 1][1]

    return "".join(parts), at


#: What stays inside a masked span.
_KEPT = re.compile(r"(-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\[nrt]|[\"'`]\s*(?:\+|\.\.?|\|\||&|\\\r?\n)?\s*[\"'`]|\\?\r?\n[ \t]*|\r|^[\"'`]|[\"'`]$)")


def mask(code: str, spans: list[tuple[int, int]]) -> str:
    """The code with the secrets masked; quotes, joins, armour lines, escapes and line ends inside a span stay."""
    out, last = [], 0
    for a, b in spans:
        out.append(code[last:a])
        kept = _KEPT.split(code[a:b])
        out += [part if i % 2 else "*" * len(part) for i, part in enumerate(kept)]
        last = b
    out.append(code[last:])
    return "".join(out)


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for cid, path, code in zip(pdf["chunk_id"], pdf["file_path"], pdf["code"], strict=True):
            for line in sorted({code.count("\n", 0, a) + 1 for a, _ in find(code, path)}):
                rows.append((cid, line))
        yield pd.DataFrame(rows, columns=["chunk_id", "line_no"])


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = [find(code, path) for path, code in zip(pdf["file_path"], pdf["code"], strict=True)]
        out = pdf.assign(n=[len(s) for s in spans], code=[mask(c, s) for c, s in zip(pdf["code"], spans, strict=True)])
        yield out[out["n"] > 0][["chunk_id", "file_path", "code", "n"]]


def _usable(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "file_path", "code")
    return rows.filter(F.col("chunk_id").isNotNull() & F.col("code").isNotNull() & (F.length("code") > 5))


def secret_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no)``: the lines on which a credential begins. Only the findings are shuffled, to make them distinct."""
    return _usable(chunks).mapInPandas(_found, "chunk_id long, line_no long").distinct()


def masked_chunks(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, file_path, code, n)``: the chunks that hold credentials, masked, and their number of findings."""
    return _usable(chunks).mapInPandas(_masked, "chunk_id long, file_path string, code string, n long").distinct()
