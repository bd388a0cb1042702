"""Credentials in a text column: known token shapes, key blocks and high-entropy strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import spans as S
from sieveline.functions import text as X
from sieveline.functions.expr import let
from sieveline.functions.regex import group_pattern

ENTROPY_LABEL = "high_entropy"
PEM_LABEL, JWT_LABEL = "pem_key_block", "jwt"

# Necessary conditions, checked before the patterns. Tokens and high-entropy strings are long unbroken runs, which
# ordinary prose does not have; the run is looked for once for all of them.
_RUN = r"(?<![A-Za-z0-9+/=._\-])[A-Za-z0-9+/=._\-]{%d}"
_KEY_WORD = r"(?i)key|token|password|secret"
_LITERALS = {"slack_token": "xox", "discord_like": "DISCORD"}
_BY_KEY_WORD = ("kv_quoted", "kv_bare")
_NO_RUN = ("discord_token", "discord_bot_token", "basic_auth_creds", "cloudant_creds", "slack_webhook_path", "PEM 패턴", "slack_token")
# The runs of a text, brought together, are short: what a token needs of its run is looked for in them, so that a pattern reads
# whole texts only where it will most likely match. Other tokens need a run of any kind.
_RUNS = r"(?<![A-Za-z0-9+/=._\-])[A-Za-z0-9+/=._\-]{16,}"
_IN_RUN = {
    "google_api_key": "AIza", "github_token": "gh[pousr][-_]", "stripe_key": "sk_(?:live|test)_", "twilio_api": "SK[0-9a-fA-F]{32}",
    "sendgrid_api": r"SG\.", "aws_access_key_id": "(?:AKIA|ASIA|ANPA|ABIA)[0-9A-Z]{16}", "aws_secret_access_key": "[A-Za-z0-9/+=]{40}",
    "openai_like": "sk-[A-Za-z0-9]{16}", "mailchimp_api_key": "[0-9a-f]{32}-us", "stripe_secret": "sk_(?:live|test)_",
    "stripe_publishable": "pk_(?:live|test)_", "twilio_account_sid": "AC[0-9a-fA-F]{32}", "twilio_auth_token": "[0-9a-fA-F]{32}",
    "ak_tk_token": "(?:ak|tk)-[a-f0-9]{16}", "JWT": r"[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8}",
    JWT_LABEL: r"[A-Za-z0-9_-]{10}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10}", ENTROPY_LABEL: r"[A-Za-z0-9+/=._\-]{20}"}
# Key words count in front of a sign; white space as Unicode has it.
_KEY_SIGN = r"(?i)(?:key|token|password|secret)[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*[:=]"
_BY_URL = ("basic_auth_creds", "cloudant_creds", "slack_webhook_path")


def _runs(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0)), " ")


def _in_run(runs: Column, name: str) -> Column:
    return runs.rlike(_IN_RUN[name]) if name in _IN_RUN else runs != ""


def high_entropy_spans(text: Column, *, hex_first: bool = False, ord_: int = 0) -> Column:
    found = S.find_spans(text, C.ENTROPY_CANDIDATE, ENTROPY_LABEL, ord_=ord_)
    return F.filter(found, lambda s: X.is_high_entropy(s["value"], hex_first))


def secret_spans(text: Column, *, hex_first: bool = False) -> Column:
    """Spans of key blocks, JWTs, known tokens and high-entropy strings, in that order; they may overlap."""

    def gated(runs: Column, key_word: Column) -> Column:
        last = 2 + len(C.KNOWN_TOKENS)
        rules = [S.SpanRule(C.PEM_BLOCK, PEM_LABEL, ord=0, gate=F.contains(text, F.lit("-----BEGIN "))),
                 S.SpanRule(C.JWT, JWT_LABEL, ord=1, gate=_in_run(runs, JWT_LABEL))]
        for i, (name, pattern) in enumerate(C.KNOWN_TOKENS):
            if name in _LITERALS:
                gate = F.contains(text, F.lit(_LITERALS[name]))
            elif name in _BY_KEY_WORD:
                gate = key_word
            else:
                gate = None if name in _NO_RUN else _in_run(runs, name)
            rules.append(S.SpanRule(pattern, name, ord=2 + i, group="VAL", gate=gate))
        rules.append(S.SpanRule(C.ENTROPY_CANDIDATE, ENTROPY_LABEL, ord=last, gate=_in_run(runs, ENTROPY_LABEL)))
        return F.filter(S.spans_of(text, rules), lambda s: (s["ord"] < last) | X.is_high_entropy(s["value"], hex_first))

    return let(_runs(text), lambda runs: let(text.rlike(_KEY_WORD) & text.rlike(_KEY_SIGN), lambda key_word: gated(runs, key_word)))


def findings(text: Column, spans: Column) -> Column:
    """``array<struct<label,start,end,match>>``; the sample is cut, as findings go to logs."""
    whole = F.array(F.lit(PEM_LABEL), F.lit(JWT_LABEL))

    def sample(s: Column) -> Column:
        # Block samples are the next characters of the text, marked as cut in every case.
        from_text = F.concat(F.substring(text, s["start"] + 1, F.lit(C.SAMPLE_CHARS)), F.lit("..."))
        own = F.concat(F.substring(s["value"], 1, C.SAMPLE_CHARS),
                       F.when(F.length(s["value"]) > C.SAMPLE_CHARS, "...").otherwise(""))
        return F.when(F.array_contains(whole, s["type"]), from_text).otherwise(own)

    return F.transform(spans, lambda s: F.struct(
        s["type"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), sample(s).alias("match")))


def finding_counts(spans: Column) -> Column:
    """``struct<known,entropy,pem,jwt,total_spans>``."""
    return let(spans, _finding_counts)


def _finding_counts(spans: Column) -> Column:
    def n(test) -> Column:
        return F.size(F.filter(spans, test))

    special = [PEM_LABEL, JWT_LABEL, ENTROPY_LABEL]
    return F.struct(
        n(lambda s: ~s["type"].isin(special)).alias("known"), n(lambda s: s["type"] == ENTROPY_LABEL).alias("entropy"),
        n(lambda s: s["type"] == PEM_LABEL).alias("pem"), n(lambda s: s["type"] == JWT_LABEL).alias("jwt"),
        F.size(spans).alias("total_spans"))


def cloud_secret_spans(text: Column, rules=C.CLOUD_RULES) -> Column:
    """Spans of the sample cloud and SaaS rules; a named group narrows the span."""
    # Gates belong to the catalogue's own rules, not to their names: a rule of the user has none.
    known = {tuple(rule) for rule in C.CLOUD_RULES}

    def gate_of(rule: tuple, runs: Column) -> Column | None:
        if rule not in known:
            return None
        if rule[0] in _BY_URL:
            return F.contains(text, F.lit("://"))
        if rule[1] == C.PEM_BLOCK:
            return F.contains(text, F.lit("-----BEGIN "))
        if rule[0] in _LITERALS:
            return F.contains(text, F.lit(_LITERALS[rule[0]]))
        return None if rule[0] in _NO_RUN else _in_run(runs, rule[0])

    def gated(runs: Column) -> Column:
        looked_for = []
        for i, (name, rule, _action, flags, group) in enumerate(rules):
            if group is not None and group_pattern(rule, group, flags) is None:
                raise ValueError(f"rule {name!r}: its group needs operators.rules.spans_in_python")
            looked_for.append(S.SpanRule(rule, name, ord=i, flags=flags, group=group, gate=gate_of((name, rule, _action, flags, group), runs)))
        return S.spans_of(text, looked_for)

    # 16 is the length of the shortest gated token.
    return let(_runs(text), gated)
