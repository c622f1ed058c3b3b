"""Lexers that turn source text into the token kinds of :mod:`grammars`.

Each splits the text with one compiled expression and maps the pieces through a
dictionary, so that the work per token stays in C; only what depends on the
context (indentation, inserted semicolons, string interpolation) is done by hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from . import grammars
from .gll import CLOSERS, NEWLINE_FLAG, OPENERS, Grammar

SPACE, BREAK, BAD = -1, -2, -3
_CACHE_LIMIT = 300_000


class _Kinds(dict):
    """Kind by spelling; spellings not seen before go through ``classify``."""

    def __init__(self, fixed: dict[str, int], classify: Callable[[str], object]):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, s: str):
        k = self.classify(s)
        if len(s) < 200:
            if len(self) > _CACHE_LIMIT:
                self.clear()
                self.update(self.fixed)
            self[s] = k
        return k


# How literals are written, beyond what the lexers' pieces say.
#: A number that begins with 0 is octal: no 8 or 9 in it.
WRONG_OCTAL = re.compile(r"0[\d_]*[89][\d_]*[lL]?")
#: Underscores stand between digits, and a prefix has digits behind it.
WRONG_DIGITS = re.compile(r"0[xXbBoO][lLn]?|.*_(?:[lLfFdDn]|\.|)|.*\._.*", re.S)
GO_STRING = re.compile(r"\"(?:[^\\]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*\"", re.S)
RUST_STRING = re.compile(r"[bc]?\"(?:[^\\]|\\(?:[nrt\\0'\"\n\r]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))*\"", re.S)
JS_STRING = re.compile(r"(?:[^\\]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{[\da-fA-F]{1,8}\}|0(?!\d)|[^xu\d]))*", re.S)
JS_NUMBER = re.compile(
    r"0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:0|[1-9](?:_?\d)*)n"
    r"|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
)
PYTHON_STRING = re.compile(r"(?:[^\\]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U00(?:0[\da-fA-F]|10)[\da-fA-F]{4}|N\{[^{}]+\}|[^xuUN]))*", re.S)
PYTHON_BYTES = re.compile(r"(?:[^\\]|\\(?:x[\da-fA-F]{2}|[^x]))*", re.S)


class Language:
    """A language: ``valid(text)`` says whether any of its dialects derives the text."""

    dialects = ("file",)
    grammar_text = ""
    pattern = ""
    flags = re.S
    #: Whether tokens carry newline marks.
    newlines = False
    #: Where statements are folded (bracket numbers; the whole text too) and the token that ends them.
    segment_in: tuple[int, ...] = ()
    terminator = ""
    #: Token classes of words that are no identifiers, by word.
    word_classes: dict[str, str] = {}

    def __init__(self):
        self.grammar = Grammar(self.grammar_text)
        self.find = re.compile(self.pattern, self.flags).findall
        k = self.grammar.kind
        fixed = {s: n for s, n in k.items() if not (s.isupper() and s.isalpha())}
        fixed |= {w: k[c] if c else BAD for w, c in self.word_classes.items()}
        self.identifier = k.get("IDENT", BAD)
        if self.terminator:
            self.grammar.segment_in, self.grammar.terminator = self.segment_in, k[self.terminator]
        self.kinds = _Kinds(fixed, self._kind)

    def k(self, name: str) -> int:
        return self.grammar.kind[name]

    def _kind(self, s: str):
        return self.identifier if s.isidentifier() else self.classify(s)

    def classify(self, s: str):
        """The kind of a piece that is neither a fixed token nor an identifier."""
        raise NotImplementedError

    def tokens(self, text: str) -> list[int] | None:
        """Token kinds, or None if some character starts no token."""
        kinds = [k for k in map(self.kinds.__getitem__, self.find(text)) if k != SPACE]
        return None if BAD in kinds else kinds

    def valid(self, text: str) -> bool:
        kinds = self.tokens(text)
        return kinds is not None and self.grammar.accepts(kinds, list(self.dialects), self.newlines)

    def derives(self, text: str, rule: str) -> bool:
        """Whether the rule derives this piece of text."""
        kinds = self.tokens(text)
        if kinds is None:
            return False
        folded = self.grammar.fold(kinds, whole=False)
        return folded is not None and self.grammar.run(folded, [(0, rule)]) != 0


class Json(Language):
    grammar_text = grammars.JSON
    pattern = r"""[ \t\n\r]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[{}\[\]:,]|."""
    flags = re.S | re.A

    def classify(self, s: str):
        if s[0] in " \t\n\r":
            return SPACE
        if s[0] == '"' and len(s) > 1:
            return self.k("STR")
        return self.k("NUM") if s[0] in "-0123456789" and s != "-" else BAD


def _word_kind(lang: Language, s: str):
    return lang.k("IDENT") if s.isidentifier() else BAD


class Go(Language):
    grammar_text = grammars.GO
    pattern = (
        r"[ \t\r]+|\n|//[^\n]*|/\*.*?\*/|[^\W\d]\w*"
        r"|0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?"
        r"|\"(?:[^\"\\\n]|\\[abfnrtv\\\"'0-7xuU])*+\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'"
        r"|&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^<>=!()\[\]{},;.:~]|."
    )

    def __init__(self):
        super().__init__()
        g = self.grammar.kind
        self.kinds.fixed["\n"] = self.kinds["\n"] = BREAK
        ends = [g[x] for x in ("IDENT", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--")]
        self.ends = {*ends, *CLOSERS.values()}

    def classify(self, s: str):
        c = s[0]
        if c in " \t\r" or s.startswith("//"):
            return SPACE
        if s.startswith("/*") and len(s) > 3:
            return BREAK if "\n" in s else SPACE
        if c in "\"`" and len(s) > 1:
            return BAD if c == '"' and "\\" in s and not GO_STRING.fullmatch(s) else self.k("STR")
        if c == "'" and len(s) > 1:
            return self.k("CHAR")
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return BAD if WRONG_OCTAL.fullmatch(s) or "__" in s or WRONG_DIGITS.fullmatch(s) else self.k("NUM")
        if s in ("&^=", "<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
            return self.k("ASSIGN")
        if s in ("&^", "<<", ">>", "&&", "||", "==", "!=", "<=", ">=", "/", "%", "<", ">"):
            return self.k("OP")
        return _word_kind(self, s)

    def tokens(self, text: str):
        kinds = [k for k in map(self.kinds.__getitem__, self.find(text.removeprefix("\ufeff"))) if k != SPACE]
        if BAD in kinds or "\0" in text:
            return None
        out, last, ends, semicolon = [], 0, self.ends, self.k(";")
        for k in kinds:
            if k == BREAK:
                if last in ends:
                    out.append(semicolon)
                    last = semicolon
            else:
                # a semicolon may be left out before a closing bracket; the grammar allows both
                out.append(k)
                last = k
        if last in ends:
            out.append(semicolon)
        return out


class Java(Language):
    grammar_text = grammars.JAVA
    word_classes = {
        **dict.fromkeys("public protected private abstract native transient volatile strictfp".split(), "MOD"),
        **dict.fromkeys("int long short byte char boolean float double".split(), "PRIM"),
        **dict.fromkeys(("const", "goto", "_"), ""),
    }
    dialects = ("file", "modular")
    pattern = (
        r"\s+|//[^\n]*|/\*.*?\*/|[^\W\d][\w$]*|\$[\w$]*"
        r"|0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?"
        r"|\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n\r]|\\[btnfrs\"'\\0-7u])*+\"|'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))'"
        r"|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^<>=!~?:;,.()\[\]{}@]|."
    )

    def classify(self, s: str):
        c = s[0]
        if c.isspace() or s.startswith("//") or s.startswith("/*") and len(s) > 3:
            return SPACE
        if c == '"' and len(s) > 1:
            return self.k("STR")
        if c == "'" and len(s) > 1:
            return self.k("CHAR")
        if c.isdigit() or c == "." and s[1:2].isdigit():
            return BAD if WRONG_OCTAL.fullmatch(s) or WRONG_DIGITS.fullmatch(s) else self.k("NUM")
        if s in ("<<=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%="):
            return self.k("ASSIGN")
        if s in ("&&", "||", "==", "!=", "<=", "<<", "/", "%", "^"):
            return self.k("OP")
        return self.k("IDENT") if s.replace("$", "_").isidentifier() else BAD

    def tokens(self, text: str):
        return super().tokens(text.rstrip("\x1a").removeprefix("\ufeff"))


class JavaScript(Language):
    grammar_text = grammars.JAVASCRIPT
    newlines = True
    _str = r"\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*+\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*+'"
    _chars = r"(?:[^`\\$]|\\.|\$(?!\{))*+"
    _regex = r"/(?![/*])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
    _before = r"(?:=>|===?|!==?|&&|\|\||\?\?|(?<!\+)\+|(?<!-)-|[(,=:\[!&|?{};*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|await|yield|instanceof)\b)"
    pattern = (
        r"\A#![^\n]*|[ \t\f\v\xa0\ufeff]+|[\r\n\u2028\u2029]\s*|//[^\n\r\u2028\u2029]*|/\*.*?\*/"
        rf"|{_before}(?:\s|//[^\n]*\n|/\*.*?\*/)*+{_regex}|\A{_regex}"
        r"|[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*|\#\$[\w$]*|(?:\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})[\w$]*"
        r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
        rf"|{_str}|`{_chars}`"
        r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
        r"|[-+*/%&|^<>=!~?:;,.()\[\]{}@]|."
    )
    _ops = frozenset(
        "== != === !== <= >= < > << >> >>> & | ^ / %".split()
    )
    _assigns = frozenset("+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())

    def __init__(self):
        super().__init__()
        self.split_regex = re.compile(rf"({self._before})(?:\s|//[^\n]*\n|/\*.*?\*/)*({self._regex})\Z", re.S)
        self.plain, self.find = self.find, self._pieces
        self.finditer = re.compile(self.pattern, self.flags).finditer
        self.template = re.compile(rf"{self._chars}(`|\$\{{)", re.S).match
        self.first_regex = re.compile(rf"(?:\s|//[^\n]*\n|/\*.*?\*/)*+{self._regex}", re.S).match

    def classify(self, s: str):
        c = s[0]
        if c in "\r\n\u2028\u2029":
            return BREAK
        if c in " \t\f\v\xa0\ufeff" or s.startswith("//"):
            return SPACE
        if s.startswith("/*") and len(s) > 3:
            return BREAK if "\n" in s else SPACE
        if c in "\"'" and len(s) > 1:
            return BAD if "\\" in s and not JS_STRING.fullmatch(s) else self.k("STR")
        if c == "`" and len(s) > 1:
            return self.k("TEMPLATE")
        if s in self._ops:
            return self.k("OP")
        if s in self._assigns:
            return self.k("ASSIGN")
        if s.startswith("#!"):
            return self.k("HASHBANG")
        if c == "/" and len(s) > 2:
            return self._regex_kind(s)
        if len(s) > 2 and (m := self.split_regex.match(s)) and m[1] != s:
            regex = self._regex_kind(m[2])
            return BAD if regex == BAD else (self.kinds[m[1]], regex)
        if c.isdigit() or c == "." and s[1:2].isdigit():
            return self.k("NUM") if JS_NUMBER.fullmatch(s) else BAD
        if c == "#":
            return self.k("PRIVATE") if len(s) > 1 else BAD
        return self.k("IDENT") if c in "\\$" and len(s) > 1 or c == "$" or s.replace("$", "_").isidentifier() else BAD

    def _regex_kind(self, s: str) -> int:
        flags = s[s.rindex("/") + 1 :]
        fine = set(flags) <= set("dgimsuvy") and len(set(flags)) == len(flags) and not {"u", "v"} <= set(flags)
        return self.k("REGEX") if fine else BAD

    def valid(self, text: str) -> bool:
        kinds = self.tokens(text)
        return kinds is not None and self.grammar.accepts(kinds, list(self.dialects), True) and self._placed(kinds)

    def _placed(self, kinds: list[int]) -> bool:
        """Whether ``return``, ``break``, ``continue`` and ``await`` stand where their functions and loops allow them.

        Runs over the tokens of a derived text.  A brace opens a function's body behind an arrow, or
        behind a parenthesis that no statement word precedes; every body has its own loops.
        """
        mask, k = NEWLINE_FLAG - 1, self.grammar.kind
        words = [k[w] for w in ("return", "break", "continue", "await")]
        plain = [x & mask for x in kinds]
        if not set(words).intersection(plain):
            return True
        ret, brk, cont, wait = words
        heads = {k[w] for w in ("if", "while", "for", "switch", "catch", "with")}
        loops, switch, names = {k["for"], k["while"], k["do"]}, k["switch"], {k["."], k["?."]}
        colon, asynchronous, as_, arrow, identifier = k[":"], k["async"], k["as"], k["=>"], k["IDENT"]
        # a frame: its closing bracket, whether it is within a function, whether that may be asynchronous, and whether a loop and a switch came before
        frames = [[-1, False, True, False, False]]
        opened: list[int] = []
        paren = -1  # where the last closed parenthesis was opened
        watched = {*words, *loops, switch, asynchronous}
        # only brackets and these words need a step
        for i in [i for i, x in enumerate(plain) if x < 7 or x in watched]:
            t = plain[i]
            if t < 3:
                f = frames[-1]
                body = sync = False
                if t == 2 and i:
                    before = plain[i - 1]
                    if before == arrow:
                        j = paren if plain[i - 2] == 4 else i - 2
                        body, sync = True, plain[j - 1] != asynchronous
                    elif before == 4 and paren and plain[paren - 1] not in heads and not (plain[paren - 1] == wait and paren > 1 and plain[paren - 2] == k["for"]):
                        body, sync = True, plain[paren - 1] != 5 and asynchronous not in plain[max(0, paren - 4) : paren]
                    elif before == k["static"]:
                        body = True
                opened.append(i)
                frames.append([t + 4, True, not sync, False, False] if body else [t + 4, *f[1:]])
            elif 4 <= t < 7:
                if len(frames) > 1:
                    frames.pop()
                    at = opened.pop()
                    paren = at if t == 4 else paren
            elif t in loops:
                frames[-1][3] = True
            elif t == switch:
                frames[-1][4] = True
            elif t == asynchronous:
                frames[-1][2] = True
            elif t in words:
                after = plain[i + 1] if i + 1 < len(plain) else -1
                if i and plain[i - 1] in names or after in (colon, as_) or (after == 0 and len(frames) > 1):
                    continue  # a name of a property or a method
                if i and plain[i - 1] == as_:
                    continue
                _, function, asy, loop, sw = frames[-1]
                labelled = after == identifier and not kinds[i + 1] & NEWLINE_FLAG
                if t == ret and not function or t == wait and not asy:
                    return False
                if t in (brk, cont) and not labelled and not loop and not (sw and t == brk):
                    return False
        return True

    def tokens(self, text: str):
        pieces = self._templates(text) if "`" in text and "${" in text else map(self.kinds.__getitem__, self.plain(text))
        return None if pieces is None else self._marked(pieces)

    def _pieces(self, text: str) -> list[str]:
        """The spellings of the pieces, a template in one; every character apart from a template that is open."""
        spelled: list[str] = []
        return spelled if "`" in text and "${" in text and self._templates(text, spelled) is not None else self.plain(text)

    def _marked(self, pieces) -> list[int] | None:
        """The kinds with their newline marks, or None if some character starts no token."""
        out: list[int] = []
        mark = NEWLINE_FLAG
        for k in pieces:
            if k.__class__ is tuple:
                out.append(k[0] | mark)
                out.append(k[1])
                mark = 0
            elif k >= 0:
                out.append(k | mark)
                mark = 0
            elif k == BREAK:
                mark = NEWLINE_FLAG
            elif k == BAD:
                return None
        return out

    def _templates(self, text: str, spelled: list[str] | None = None) -> list | None:
        """The pieces' kinds, each template as one, whatever its depth; None if one is open or holds no expression.

        Every open substitution has a frame: the pieces around it, and their open braces.  With
        ``spelled``, the outermost spellings are added to it and the expressions are not looked at.
        """
        kinds, grammar = self.kinds, self.grammar
        template, opener, closer = self.k("TEMPLATE"), OPENERS["{"], CLOSERS["}"]
        out: list = []
        frames: list[tuple[list, int]] = []
        depth, at, begin = 0, 0, 0
        while at >= 0:
            for m in self.finditer(text, at):
                s = m[0]
                if s[0] == "}" and frames and not depth:
                    # the brace alone: what follows it belongs to the template
                    if spelled is None:
                        inner = self._marked(out)
                        folded = None if inner is None else grammar.fold(inner, whole=False)
                        if folded is None or not grammar.run(folded, [(0, "substitution")]):
                            return None
                    out, depth = frames.pop()
                    at = m.start() + 1
                elif s == "`":
                    at = m.end()
                    begin = begin if frames else m.start()
                else:
                    k = kinds[s]
                    low = k[0] if k.__class__ is tuple else k
                    if low == opener:
                        depth += 1
                    elif low == closer:
                        depth -= 1
                    out.append(k)
                    if spelled is not None and not frames:
                        spelled.append(s)
                    continue
                # within a template: to its end, or to its next substitution
                t = self.template(text, at)
                if not t:
                    return None
                at = t.end()
                if t[1] == "`":
                    out.append(template)
                    if spelled is not None and not frames:
                        spelled.append(text[begin:at])
                else:
                    frames.append((out, depth))
                    out, depth = [], 0
                    if r := self.first_regex(text, at):
                        out.append(self.k("REGEX"))
                        at = r.end()
                break
            else:
                at = -1
        return None if frames else out


class Python(Language):
    grammar_text = grammars.PYTHON
    segment_in = (3,)
    terminator = "NL"
    _pre = r"(?:[rRbBuUfFtT]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?"
    #: A replacement field of an f-string may hold the quotes that enclose it.
    _field_text = r"\{(?:[^{}'\"]|'[^'\n]*'|\"[^\"\n]*\"|\{[^{}\n]*\})*+\}"
    pattern = (
        rf"[ \t\f]+|\#[^\n\r]*|\\\r?\n|\r?\n[ \t\f]*|\r[ \t\f]*"
        rf"|[fF][rR]?'(?!'')(?:[^'\\\n{{]|\\.|\{{\{{|{_field_text})*+'|[fF][rR]?\"(?!\"\")(?:[^\"\\\n{{]|\\.|\{{\{{|{_field_text})*+\""
        rf"|{_pre}\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|{_pre}'''(?:[^\\']|\\.|'(?!''))*+'''"
        rf"|{_pre}\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|.))*+\"|{_pre}'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|.))*+'"
        r"|[^\W\d]\w*|0[xX](?:_?[\da-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)"
        r"|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?![^\W_a-zA-Z]|_|\d)"
        r"|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|<<|>>|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=!]|."
    )

    def classify(self, s: str):
        c = s[0]
        if c in " \t\f#\\" and (c != "\\" or len(s) > 1):
            return SPACE
        if c in "\r\n":
            return (BREAK, s.lstrip("\r\n"))
        if s[-1] in "\"'" and len(s) > 1:
            prefix = s[: min(s.find(q) for q in "\"'" if q in s)].lower()
            if ("f" in prefix or "t" in prefix) and "{" in s and not self._fields(s, "r" in prefix):
                return BAD
            if "b" in prefix and not s.isascii():
                return BAD
            if "r" not in prefix and "\\" in s and not (PYTHON_BYTES if "b" in prefix else PYTHON_STRING).fullmatch(s):
                return BAD
            return self.k("STR")
        if c.isdigit() or c == "." and s[1:2].isdigit():
            if len(s) > 1 and c == "0" and s.isdigit() and s.strip("0"):
                return BAD
            return self.k("NUM")
        if s in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="):
            return self.k("AUG")
        if s in ("==", "!=", "<", ">", "<=", ">="):
            return self.k("CMP")
        if s in ("/", "//", "%", "@", "<<", ">>", "**"):
            return self.k("OP")
        return _word_kind(self, s)

    def _fields(self, s: str, raw: bool) -> bool:
        """Whether the replacement fields of an f-string hold expressions."""
        q = s[-3:] if s[-3:] in ('"""', "'''") and len(s) > 5 else s[-1]
        body = s[s.index(q) + len(q) : -len(q)]
        i, n = 0, len(body)
        while i < n:
            c = body[i]
            if c == "\\" and not raw:
                i += 3 if body[i + 1 : i + 3] == "N{" and (i := body.find("}", i) - 2) >= 0 else 2
            elif c in "{}" and body[i + 1 : i + 2] == c:
                i += 2
            elif c == "}":
                return False
            elif c == "{":
                i = self._field(body, i + 1)
                if i < 0:
                    return False
            else:
                i += 1
        return True

    def _field(self, body: str, i: int) -> int:
        """Reads one field from just after its brace; the place after it, or -1."""
        depth, j, n, quote = 0, i, len(body), ""
        while j < n:
            c = body[j]
            if quote:
                if body.startswith(quote, j):
                    j += len(quote) - 1
                    quote = ""
                elif c == "\\":
                    j += 1
            elif c in "\"'":
                quote = c * 3 if body.startswith(c * 3, j) else c
                j += len(quote) - 1
            elif c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif not depth and (c in "}:" or c == "!" and body[j + 1 : j + 2] != "="):
                break
            j += 1
        if j >= n:
            return -1
        expr = body[i:j].strip()
        if expr.endswith("=") and expr[-2:-1] not in "=!<>":
            expr = expr[:-1]
        if not expr or not self.derives(f"({expr})", "field"):
            return -1
        if body[j] == "!":
            if body[j + 1 : j + 2] not in ("r", "s", "a"):
                return -1
            j += 2
        if body[j : j + 1] == ":":
            j += 1
            while j < n and body[j] != "}":
                j = self._field(body, j + 1) if body[j] == "{" else j + 1
                if j < 0:
                    return -1
        return j + 1 if body[j : j + 1] == "}" else -1

    def tokens(self, text: str):
        if "\0" in text:
            return None
        text = text.removeprefix("\ufeff")
        out: list[int] = []
        add = out.append
        newline, indent, dedent = self.k("NL"), OPENERS["INDENT"], CLOSERS["DEDENT"]
        depth, levels, pending = 0, [0], "" if not text or text[0] not in " \t\f" else text[: len(text) - len(text.lstrip(" \t\f"))]
        fresh = True  # at the beginning of a logical line
        for k in map(self.kinds.__getitem__, self.find(text)):
            if k.__class__ is tuple:
                if not depth:
                    if not fresh:
                        add(newline)
                        fresh = True
                    pending = k[1]
            elif k >= 0:
                if fresh and not depth:
                    fresh = False
                    if pending or len(levels) > 1:
                        width = len(pending.expandtabs(8)) if pending else 0
                        if width > levels[-1]:
                            levels.append(width)
                            add(indent)
                        else:
                            while width < levels[-1]:
                                levels.pop()
                                add(dedent)
                            if width != levels[-1]:
                                return None
                    pending = ""
                add(k)
                if k < 3:
                    depth += 1
                elif 3 < k < 7:
                    depth -= 1
                    if depth < 0:
                        return None
            elif k == BAD:
                return None
        if depth:
            return None
        if not fresh:
            add(newline)
        out.extend([dedent] * (len(levels) - 1))
        return out


class Rust(Language):
    grammar_text = grammars.RUST
    segment_in = (2,)
    terminator = ";"
    pattern = (
        r"\A\#!(?!\s*\[)[^\n]*|\s+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/|r\#[^\W\d]\w*"
        r"|(?:b|c)?\"(?:[^\"\\]|\\.)*+\"|(?:br|cr|r)\"[^\"]*\"|RAW"
        r"|b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}))'|'[^\W\d]\w*(?!')|[^\W\d]\w*"
        r"|0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?"
        r"|\d[\d_]*(?:\.(?!\.|[^\W\d])(?:\d[\d_]*)?)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?"
        r"|<<=|>>=|\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|[-+*/%&|^<>=!?:;,.()\[\]{}@\#$~]|."
    )
    _comments = re.compile(
        r"/\*|\*/|//[^\n]*|(?:br|cr|r)(\#+)\".*?\"\1|(?:br|cr|r)\"[^\"]*\"|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)'|[^/*\"'rbc]+|.", re.S
    )

    _raw_opening = re.compile(r"r(\#+)\"").findall

    def __init__(self):
        super().__init__()
        g = self.grammar.kind
        self._finders: dict[int, Callable] = {}
        self.find = self._pieces
        #: Tokens that only macros and attributes may hold.
        self.extra = g.setdefault("$", len(g))

    def classify(self, s: str):
        c = s[0]
        if c.isspace() or s.startswith("//") or s.startswith("/*") and len(s) > 3 or s.startswith("#!"):
            return SPACE
        if s[-1] == '"' and len(s) > 1 or s[-1] == "#" and s[0] in "rbc" and len(s) > 2:
            return BAD if "\\" in s and "r" not in s[: s.index('"')] and not RUST_STRING.fullmatch(s) else self.k("STR")
        if s[-1] == "'" and len(s) > 1:
            return self.k("CHAR")
        if c == "'":
            return self.k("LIFETIME") if len(s) > 1 else BAD
        if c.isdigit():
            return self.k("NUM")
        if s in ("==", "!=", "<="):
            return self.k("CMP")
        if s in ("+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="):
            return self.k("ASSIGN")
        if s in ("<<", "/", "%", "^"):
            return self.k("OP")
        if s in "$~" or s == "@":
            return self.extra
        return self.k("IDENT") if s.startswith("r#") or s.isidentifier() else BAD

    def _pieces(self, text: str) -> list[str]:
        """The text's pieces, by the expression for raw strings with as many # as some opening of the text has; the language allows 255."""
        n = min(max(map(len, self._raw_opening(text)), default=0), 255)
        if n not in self._finders:
            marks = [rf"\#{{{i}}}" for i in range(1, n + 1)]
            raw = "|".join(rf"(?:br|cr|r){x}\".*?\"{x}" for x in marks) or "(?!)"
            self._finders[n] = re.compile(self.pattern.replace("RAW", raw, 1), self.flags).findall
        return self._finders[n](text)

    def tokens(self, text: str):
        text = text.removeprefix("\ufeff")
        kinds = [k for k in map(self.kinds.__getitem__, self.find(text)) if k != SPACE]
        if "/*" in text and (BAD in kinds or self._has_nested(text)):
            kinds = [k for k in map(self.kinds.__getitem__, self.find(self._without_comments(text))) if k != SPACE]
        return None if BAD in kinds else kinds

    def _has_nested(self, text: str) -> bool:
        first = text.find("/*")
        return first >= 0 and "/*" in text[first + 2 :]

    def _without_comments(self, text: str) -> str:
        """The text with nested block comments replaced by a space."""
        out, depth = [], 0
        i = 0
        while i < len(text):
            if depth:
                a, b = text.find("/*", i), text.find("*/", i)
                if b < 0:
                    break
                if 0 <= a < b:
                    depth, i = depth + 1, a + 2
                else:
                    depth, i = depth - 1, b + 2
                    if not depth:
                        out.append(" ")
                continue
            m = self._comments.match(text, i)
            if m[0] == "/*":
                depth = 1
            else:
                out.append(m[0])
            i = m.end()
        if depth:
            out.append("\x00")  # never closed: a character that starts no token
        return "".join(out)


LANGUAGES: dict[str, type[Language]] = {"python": Python, "rust": Rust, "javascript": JavaScript, "go": Go, "java": Java, "json": Json}
_made: dict[str, Language] = {}


def language(name: str) -> Language | None:
    """The language of that name (whatever its case), built once per process."""
    name = (name or "").strip().lower()
    if name not in _made:
        if name not in LANGUAGES:
            return None
        _made[name] = LANGUAGES[name]()
    return _made[name]
