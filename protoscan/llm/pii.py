"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans, checks confirm them (Luhn, mod 97, digit counts, value ranges), and
words shortly before a span raise its score. A span counts from a score of ``ACCEPT`` on. The base
kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their check, whatever stands
around them. The method adds cards and phone numbers that the base loses to digits beside them,
and further kinds. Matches and the texts between them come from one pattern each way (``split`` and
``regexp_extract_all``); their lengths give positions in code points.

Patterns use possessive repetition and start only where a run begins or the last match ended, which finds the
same matches and stays linear in long runs.

Null and empty texts have no spans. It is one pass over the rows without a shuffle; repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import columns, others

ACCEPT = 0.6
BEFORE = 40

SPAN = "struct<start:int,end:int,value:string,before:string>"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(value: str) -> str:
    """SQL: 13 to 19 digits whose Luhn sum ends in 0."""
    d = digits(value)
    double = "2 * cast(substr(n, -i, 1) as int)"
    total = f"aggregate(sequence(1, length(n)), 0, (a, i) -> a + if(i % 2 = 1, cast(substr(n, -i, 1) as int), {double} - if({double} > 9, 9, 0)))"
    return f"exists(array({d}), n -> case when length(n) between 13 and 19 then {total} % 10 = 0 else false end)"


def mod_97(value: str) -> str:
    """SQL: the remainder of an account number, its first four characters moved to the end, is 1."""
    moved = f"regexp_replace({value}, ' ', '')"
    step = "if(ascii(c) > 57, a * 100 + ascii(c) - 55, a * 10 + ascii(c) - 48) % 97"
    return f"exists(array({moved}), n -> length(n) between 15 and 34 and aggregate(split(concat(substr(n, 5), left(n, 4)), ''), 0, (a, c) -> if(c = '', a, {step})) = 1)"


def octets(value: str) -> str:
    return f"forall(split({value}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"


def digit_count(low: int, high: int):
    return lambda value: f"length({digits(value)}) between {low} and {high}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: object = None
    base: bool = False
    score: float = 0.6
    context: str = ""
    hint: str = ""

    def spans(self, text: str) -> Column:
        """array<struct<kind, start, end, score, base>> of one text column."""
        quoted = self.pattern.replace("\\", "\\\\").replace("'", "\\'")
        walk = f"""aggregate(
            arrays_zip(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0)),
            named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
            (a, x) -> if(x.`1` is null, a, named_struct(
                'at', a.at + length(x.`0`) + length(x.`1`),
                'out', concat(a.out, array(named_struct('start', a.at + length(x.`0`), 'end', a.at + length(x.`0`) + length(x.`1`), 'value', x.`1`, 'before', right(x.`0`, {BEFORE})))))),
            a -> a.out)"""
        if self.check:
            walk = f"filter({walk}, s -> {self.check('s.value')})"
        raised = f"if(lower(s.before) rlike '{self.context}', 0.3D, 0D)" if self.context else "0D"
        out = f"transform({walk}, s -> named_struct('kind', '{self.name}', 'start', s.start, 'end', s.end, 'score', least(1D, {self.score}D + {raised}), 'base', {str(self.base).lower()}))"
        if not self.base:
            out = f"filter({out}, s -> s.score >= {ACCEPT})"
        empty = "cast(array() as array<struct<kind:string,start:int,end:int,score:double,base:boolean>>)"
        return F.expr(f"case when {self.hint.format(text)} then {out} else {empty} end")


LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
DIGIT, AT, PLUS = "{0} rlike '[0-9]'", "contains({0}, '@')", "contains({0}, '+')"
NAME = r"(?:^|[^a-z])"

#: The kinds, in the order in which their spans are listed.
KINDS = [
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", base=True, score=0.9, hint=AT),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, base=True, score=0.7, context=NAME + "(ip|host|server|address)", hint=DIGIT),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, base=True, score=0.8, context=NAME + "(card|visa|credit|karte|carte|tarjeta)", hint=DIGIT),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", digit_count(9, 15), base=True, score=0.7, context=NAME + "(phone|tel|call|mobile|fax)", hint=PLUS),
    Kind("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])", luhn, score=0.7, hint=DIGIT),
    Kind("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])", digit_count(9, 15), score=0.6, context=NAME + "(phone|tel|call|mobile|fax)", hint=PLUS),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod_97, score=0.9, hint=DIGIT),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", score=0.4, context=NAME + "(ssn|social security)", hint=DIGIT),
    Kind("key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", score=0.9, hint="contains({0}, 'AKIA')"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9_+/-]{12,}+", score=0.4, context=r"(password|passwd|secret|token|api[_-]?key)[\\x20\"]{0,3}[=:][\\x20\"]{0,3}$", hint="{0} rlike '(?i)(password|passwd|secret|token|api[_-]?key)'"),
]
ORDER = ["email", "ip", "card", "phone", "iban", "ssn", "key", "secret"]


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans``: array<struct<kind, start, end, score, base>>, by kind and start; end is exclusive."""
    rest = columns(others(df, "spans"))
    whole = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = whole.select(*rest, *[kind.spans("__text").alias(f"__k{i}") for i, kind in enumerate(KINDS)])
    parts = []
    for name in ORDER:
        own = [i for i, kind in enumerate(KINDS) if kind.name == name]
        base, *added = own
        column = f"__k{base}"
        for i in added:  # an added span keeps clear of the base spans of its kind
            column = f"array_sort(concat({column}, filter(__k{i}, s -> not exists(__k{base}, b -> b.start < s.end and s.start < b.end))), (x, y) -> x.start - y.start)"
        parts.append(F.expr(column))
    return found.select(*rest, F.concat(*parts).alias("spans"))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, the digest of the base spans, and all spans as text."""
    found = find(documents.select("doc_id", "text")).select("doc_id", "spans", F.expr("filter(spans, s -> s.base)").alias("base"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in ORDER[:4]]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
