"""What a file of Java, Go or TypeScript calls, derives from and exports, read from its tokens instead of its raw text.

A file is cut into names, marks, strings and comments, so that braces and names within strings and comments don't count. Scopes are
kept on a stack while tokens go by: a brace opens a type's body, a method's body or anything else, by what stands before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"?|' + r"'(?:\\[\s\S]|[^'\\\n])*'?"
_BACK = r"`(?:\\[\s\S]|[^`\\])*`?"
_REST = r"[A-Za-z_$][\w$]*|\d[\w.]*|=>|:=|\.\.\.|[^\s]"
TOKENS = {
    "java": re.compile(rf'(?P<skip>{_COMMENT})|(?P<text>"""[\s\S]*?(?:"""|\Z)|{_QUOTED})|(?P<word>{_REST})'),
    "go": re.compile(rf"(?P<skip>{_COMMENT})|(?P<text>`[^`]*`?|{_QUOTED})|(?P<word>{_REST})"),
    "typescript": re.compile(rf"(?P<skip>{_COMMENT})|(?P<text>{_BACK}|{_QUOTED})|(?P<word>{_REST})"),
}
#: Names before a parenthesis that call nothing, by language.
NOT_CALLS = {
    "java": set("if for while switch return catch new super this else do try throw assert synchronized case".split()),
    "go": set("if for switch return func go defer range select case else map chan interface struct".split()),
    "typescript": set("if for while switch return catch new function super this else do try throw typeof await async in of case void delete yield import".split()),
}
_TYPES = {"class", "interface", "enum", "record"}


@dataclass(frozen=True)
class Token:
    text: str
    at: int
    end: int
    name: bool = False


def tokens(language: str, text: str) -> list[Token]:
    """Names, numbers and marks; a string is one token '"'. In TypeScript a slash where a value can start opens a regular expression."""
    out: list[Token] = []
    pattern, at = TOKENS[language], 0
    while m := pattern.search(text, at):
        at = m.end()
        if m["skip"]:
            continue
        if m["text"] is not None:
            out.append(Token('"', m.start(), at))
            continue
        word = m["word"]
        if word == "/" and language == "typescript" and (not out or not (out[-1].name or out[-1].text in ')]"' or out[-1].text[0].isdigit()) or out[-1].text in ("return", "typeof", "case")):
            if r := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, m.start()):
                out.append(Token('"', m.start(), r.end()))
                at = r.end()
                continue
        out.append(Token(word, m.start(), at, word[0].isalpha() or word[0] in "_$"))
    return out


def partners(ts: list[Token]) -> dict[int, int]:
    """For each opening mark the place of its closing one, and the other way round; unmatched ones are left out."""
    close, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, t in enumerate(ts):
        if t.text in "([{" and not t.name:
            stack.append(i)
        elif t.text in close:
            while stack and ts[stack[-1]].text != close[t.text]:
                stack.pop()
            if stack:
                out[stack[-1]] = i
                out[i] = stack.pop()
    return out


def _body_after(language: str, ts: list[Token], pair: dict[int, int], i: int) -> int | None:
    """The brace that opens a function's body after its parameters, which end before ``i``; None where there is none."""
    if language == "java":
        if i < len(ts) and ts[i].text == "throws":
            while i < len(ts) and ts[i].text not in "{;":
                i += 1
        return i if i < len(ts) and ts[i].text == "{" else None
    if language == "go":
        while i < len(ts):
            if ts[i].text == "{":
                if ts[i - 1].text not in ("interface", "struct"):
                    return i
                i = pair.get(i, len(ts))
            elif ts[i].text in "([":
                i = pair.get(i, len(ts))
            elif not (ts[i].name or ts[i].text in "*.,") or ts[i].text in ("func", "type", "var", "const") and ts[i - 1].text not in "(,":
                return None
            i += 1
        return None
    typed = i < len(ts) and ts[i].text == ":"
    while typed and i + 1 < len(ts):
        i += 1
        if ts[i].text == "{":
            if ts[i - 1].text not in (":", "<", "|", "&", ",", "(", "=>", "="):
                return i
            i = pair.get(i, len(ts))
        elif ts[i].text in "([":
            i = pair.get(i, len(ts))
        elif ts[i].text == "=>" or ts[i].text in ";}":
            return i + 1 if ts[i].text == "=>" and i + 1 < len(ts) and ts[i + 1].text == "{" else None
    return i if not typed and i < len(ts) and ts[i].text == "{" else None


def _scopes(language: str, ts: list[Token], pair: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Bodies of functions: their brace's place, the function's name and its place."""
    out: dict[int, tuple[str, int]] = {}
    types: list[int] = []  # ends of the bodies of types around
    for i, t in enumerate(ts):
        while types and i > types[-1]:
            types.pop()
        if t.text == "{" and i in pair and language != "go":
            j = i - 1
            while j >= 0 and ts[j].text not in ";{}":
                if ts[j].text in ")" and j in pair and language == "java":
                    j = pair[j]
                elif ts[j].text in _TYPES and (j == 0 or ts[j - 1].text != "."):
                    types.append(pair[i])
                    break
                j -= 1
            else:
                if i and ts[i - 1].text == ")" and (k := pair.get(i - 1)) is not None:
                    while k > 0 and (ts[k - 1].name or ts[k - 1].text in ".<>,"):
                        k -= 1
                        if ts[k].text == "new":  # a class without a name
                            types.append(pair[i])
                            break
        if t.text != "(" or i not in pair or not i:
            continue
        name, before = ts[i - 1], ts[i - 2].text if i > 1 else ""
        if language == "go":
            head = i - 2
            if ts[i - 1].text == "]" and (i - 1) in pair:  # type parameters
                name, head = ts[pair[i - 1] - 1], pair[i - 1] - 2
            if name.name and head >= 0 and (ts[head].text == "func" or ts[head].text == ")" and pair.get(head, 0) > 0 and ts[pair[head] - 1].text == "func"):
                body = _body_after(language, ts, pair, pair[i] + 1)
                if body in pair:
                    out[body] = (name.text, name.at)
            continue
        body = _body_after(language, ts, pair, pair[i] + 1)
        if language == "typescript" and pair[i] + 1 < len(ts) and ts[pair[i] + 1].text == "=>":
            body = pair[i] + 2 if pair[i] + 2 < len(ts) and ts[pair[i] + 2].text == "{" else None
        if body not in pair:
            continue
        if language == "typescript":
            arrow = ts[body - 1].text == "=>"
            k = i - 1
            if arrow:  # name = [async] (...) => {
                k -= ts[k].text == "async"
                if ts[k].text == "=" and k and ts[k - 1].name:
                    out[body] = (ts[k - 1].text, ts[k - 1].at)
                continue
            if name.name and name.text not in NOT_CALLS[language] and (before in ("function", "*") or types and pair[i] < types[-1] and before not in (".", "new")):
                out[body] = (name.text, name.at)
        elif name.name and name.text not in NOT_CALLS[language] and before not in (".", "new", "@") and types and i < types[-1]:
            out[body] = (name.text, name.at)
    return out


def calls(language: str, text: str) -> list[tuple[str, int, str]]:
    """(function, its line, name called): what is called anywhere within a function belongs to it, and to those around it."""
    ts = tokens(language, text)
    pair = partners(ts)
    bodies, inside, out = _scopes(language, ts, pair), [], []
    heads = {at for _, at in bodies.values()}
    for i, t in enumerate(ts):
        while inside and i > inside[-1][0]:
            inside.pop()
        if i in bodies:
            name, at = bodies[i]
            inside.append((pair[i], name, text.count("\n", 0, at) + 1))
        if inside and t.name and t.text not in NOT_CALLS[language] and t.at not in heads and i + 1 < len(ts) and ts[i + 1].text == "(":
            out += [(name, line, t.text) for _, name, line in inside]
    return out


def _list(ts: list[Token], text: str, i: int, stop: set[str]) -> tuple[str, int]:
    """The source of a list of types from ``i`` on, and where it ends."""
    start = i
    while i < len(ts) and ts[i].text not in stop:
        i += 1
    return " ".join(text[ts[start].at : ts[i - 1].end].split()) if i > start else "", i


def type_relations(language: str, text: str) -> list[tuple[str, str, str]]:
    """(type, extends_type or implements_types, names) of the types declared."""
    ts, out = tokens(language, text), []
    if language == "go":  # var _ Interface = (*Type)(nil), or = &Type{}
        for i, t in enumerate(ts):
            if t.text == "var" and i + 3 < len(ts) and ts[i + 1].text == "_":
                names, j = _list(ts, text, i + 2, {"=", ";"})
                rest = [x.text for x in ts[j : j + 5]]
                own = rest[3] if rest[:3] == ["=", "(", "*"] and len(rest) > 3 else rest[2] if rest[:2] == ["=", "&"] and len(rest) > 2 else ""
                if own and names:
                    out.append((own, "implements_types", names))
        return out
    for i, t in enumerate(ts):
        if t.text not in ("class", "interface", "enum", "record") or i + 1 >= len(ts) or not ts[i + 1].name or (i and ts[i - 1].text == "."):
            continue
        name, j = ts[i + 1].text, i + 2
        while j < len(ts) and ts[j].text not in "{;":
            if ts[j].text in ("extends", "implements"):
                how = {"extends": "extends_type", "implements": "implements_types"}[ts[j].text]
                names, j = _list(ts, text, j + 1, {"{", ";", "extends", "implements", "permits"} if ts[j - 1].text not in "<,?" else {">", ",", "{"})
                if names and (how, name) not in [(h, n) for n, h, _ in out]:
                    out.append((name, how, names))
            elif ts[j].text == "<":  # bounds of type parameters aren't what the type extends
                depth = 0
                while j < len(ts):
                    depth += {"<": 1, ">": -1}.get(ts[j].text, 0)
                    j += 1
                    if not depth:
                        break
            else:
                j += 1
    return out


def module_exports(text: str) -> list[str]:
    """The source of every declaration that a TypeScript file exports, without a closing semicolon."""
    ts = tokens("typescript", text)
    pair, out, i = partners(ts), [], 0
    while i < len(ts):
        if ts[i].text == "{" and i in pair:
            i = pair[i] + 1
            continue
        if ts[i].text == "export" and i + 1 < len(ts) and ts[i + 1].text in ("function", "async", "class", "abstract", "const", "let", "var", "interface", "type", "enum", "namespace", "declare"):
            start, j, block = i + 1, i + 1, ts[i + 1].text not in ("const", "let", "var", "type")
            while j < len(ts) and ts[j].text != ";":
                if ts[j].text in "([{" and j in pair:
                    done, j = ts[j].text == "{" and block, pair[j]
                    if done:
                        break
                if not block and j + 1 < len(ts) and "\n" in text[ts[j].end : ts[j + 1].at] and ts[j].text not in "=,(+-*|&?:" and ts[j + 1].text not in ".,?:+-*|&=)]}":
                    break
                j += 1
            last = j - 1 if j >= len(ts) or ts[j].text == ";" else j
            out.append(text[ts[start].at : ts[last].end].strip())
            i = j
        i += 1
    return out
