"""The boolean query language: lexer, postfix and infix readers, expression tree.

Infix is the documented language: blanks and && mean AND, || OR, ! NOT before
a term or group, parentheses group; ! binds before AND, AND before OR. Postfix
runs the tokens as a stack machine in which all three operators are binary, an
operator without two operands and an unknown term are skipped, and the top of
the stack is the result.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus:
    """Documents of left without those of right."""

    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    """All documents without those of of."""

    of: Node


Node = Term | And | Or | Minus | Not
OPERATORS = ("&&", "||", "!")


@dataclass(frozen=True)
class Token:
    text: str
    paren: bool = False


def lex(query: str) -> list[Token]:
    """Words, operators and parentheses; quotes keep blanks and parentheses in a word, but operators split even there."""
    out: list[Token] = []
    word, quoted, i = "", False, 0

    def flush() -> None:
        nonlocal word
        if word:
            out.append(Token(word))
            word = ""

    while i < len(query):
        c = query[i]
        if c == '"':
            quoted = not quoted
        elif c in "&|!":
            flush()
            double = query[i + 1 : i + 2] == c
            out.append(Token(c * (1 + double)))
            i += double
        elif c in " ()" and not quoted:
            flush()
            if c != " ":
                out.append(Token(c, paren=True))
        else:
            word += c
        i += 1
    flush()
    return out


def read_postfix(query: str, known) -> Node | None:
    """The tree the stack machine computes; known tells which terms are in the index."""
    stack: list[Node] = []
    build = {"&&": And, "||": Or, "!": Minus}
    for token in lex(query):
        if token.paren:
            continue
        if token.text in build:
            if len(stack) >= 2:
                right, left = stack.pop(), stack.pop()
                stack.append(build[token.text](left, right))
        elif known(token.text):
            stack.append(Term(token.text))
    return stack[-1] if stack else None


def read_infix(query: str, analyze=lambda t: [t.lower()]) -> Node | None:
    """The tree of an infix query; analyze gives a word's index terms, of which all must match. None if no term is left.

    Operators without an operand are left out, unbalanced parentheses close at the end.
    """
    tokens, at = lex(query), 0

    def peek() -> Token | None:
        return tokens[at] if at < len(tokens) else None

    def either() -> Node | None:
        nonlocal at
        left = both()
        while (t := peek()) and t.text in ("||", "|") and not t.paren:
            at += 1
            right = both()
            left = Or(left, right) if left and right else left or right
        return left

    def both() -> Node | None:
        nonlocal at
        left = single()
        while (t := peek()) and not (t.text in ("||", "|") or t == Token(")", paren=True)):
            if t.text in ("&&", "&"):
                at += 1
                continue
            right = single()
            left = And(left, right) if left and right else left or right
        return left

    def single() -> Node | None:
        nonlocal at
        t = peek()
        if t is None or t.text in ("||", "|") or t == Token(")", paren=True):
            return None
        at += 1
        if t.text in ("!", "!!"):
            inner = single()
            return Not(inner) if inner and t.text == "!" else inner
        if t.paren:
            inner = either()
            if peek() == Token(")", paren=True):
                at += 1
            return inner
        if t.text in ("&&", "&"):
            return single()
        node = None
        for term in analyze(t.text):
            node = And(node, Term(term)) if node else Term(term)
        return node

    out = None
    while peek() is not None:
        part = either()
        out = And(out, part) if out and part else out or part
        if peek() == Token(")", paren=True):
            at += 1
    return out


def terms(node: Node | None) -> list[str]:
    """The different terms of a tree, in order of appearance."""
    found: dict[str, None] = {}

    def walk(n: Node | None) -> None:
        if isinstance(n, Term):
            found[n.text] = None
        elif isinstance(n, Not):
            walk(n.of)
        elif n is not None:
            walk(n.left)
            walk(n.right)

    walk(node)
    return list(found)


def has_not(node: Node | None) -> bool:
    """Whether the tree needs the set of all documents."""
    if node is None or isinstance(node, Term):
        return False
    return isinstance(node, Not) or has_not(node.left) or has_not(node.right)
