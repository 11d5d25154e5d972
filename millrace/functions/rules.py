"""Masking rules, template correction and the rewriting that precedes template comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import WILD, normalize_ws

# The six masks, in order. Here \\d is a digit of any script.
MASKS = [
    r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)",
]

# Delimiters of the path rule, and those that the other rules add.
PATH_DELIMITERS = r"""\s,!;:=|"'\[\](){}"""
TOKEN_DELIMITERS = PATH_DELIMITERS + r".\-+@#$%&"


#: The masks without capturing groups: what stands before and behind is no letter or digit; digits are those of any script.
_FAST_MASKS = [
    "(?<![A-Za-z0-9])" + m.removeprefix("((?<=[^A-Za-z0-9])|^)").removesuffix("((?=[^A-Za-z0-9])|$)").replace(r"\d", r"\p{Nd}") + "(?![A-Za-z0-9])"
    for m in MASKS
]


def mask_common(c: Column) -> Column:
    """All masks in turn, each hit a wildcard."""
    for rule in _FAST_MASKS:
        c = F.regexp_replace(c, rule, WILD)
    return c


def _each_token(c: Column, delimiters: str, replace) -> Column:
    """``replace`` applied to every token and delimiter, put together again."""
    parts = F.split(c, rf"(?<=[{delimiters}])|(?=[{delimiters}])")
    return F.array_join(F.transform(parts, replace), "")


def mask_paths(c: Column) -> Column:
    return _each_token(c, PATH_DELIMITERS, lambda p: F.when(p.rlike(r"^(/[^/]+)+/?$"), WILD).otherwise(p))


def mask_digits(c: Column) -> Column:
    return _each_token(c, TOKEN_DELIMITERS, lambda p: F.when(p.rlike(r"(?U)^\d+$"), WILD).otherwise(p))


def mask_word_variables(c: Column) -> Column:
    return _each_token(c, TOKEN_DELIMITERS, lambda p: F.when(p.rlike(r"(?U)^[^\s/]*<\*>[^\s/]*$"), WILD).otherwise(p))


def collapse(c: Column) -> Column:
    """Neighbouring wildcards joined, each rule to its end before the next."""
    chain = lambda c, between: F.regexp_replace(c, rf"<\*>(?:{between}<\*>)+", WILD)
    c = chain(chain(c, r"\."), "")
    c = F.regexp_replace(c, r" #<\*>#(?= )", " <*>")
    c = F.regexp_replace(c, r" #<\*>(?= )", " <*>")
    for between in (":", "#", "/", "@", r"\."):
        c = chain(c, between)
    c = F.regexp_replace(c, r' "<\*>"(?= )', " <*>")
    c = F.regexp_replace(c, r" '<\*>'(?= )", " <*>")
    return chain(c, "")


def correct_template(c: Column, masks: bool = True) -> Column:
    """The whole correction: masks, white space, paths, digits, word variables, collapsing."""
    c = normalize_ws(mask_common(c) if masks else c)
    return collapse(mask_word_variables(mask_digits(mask_paths(c))))


# Template pairs (parsed, truth) that count as equal.
EQUIVALENT_PAIRS = [
    ("authentication failure; logname= uid=<*> euid=<*> tty=<*> ruser= rhost=<*> user=<*>", "authentication failure; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*> user=<*>"),
    ("<*> more authentication failure; logname= uid=<*> euid=<*> tty=<*> ruser= rhost=<*> user=<*>", "<*> more authentication failure; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*> user=<*>"),
    ("Connection broken for id <*>, my id = <*>, error =", "Connection broken for id <*>, my id = <*>, error =<*>"),
    ("New election. My id = <*>, proposed zxid=<*>", "New election. My id = <*>, proposed <*>"),
    ("Sending snapshot last zxid of peer is <*> zxid of leader is <*>sent zxid of db as <*>", "Sending snapshot last zxid of peer is <*> zxid of leader is <*> zxid of db as <*>"),
    ("PrepareForService is being done on this Midplane (mLctn(<*>), mCardSernum(<*>), iWhichCardsToPwrOff(<*>)) by <*>", "PrepareForService is being done on this Midplane (<*>, <*>, <*>) by <*>"),
    ("Error sending result ChunkFetchSuccess{streamChunkId=StreamChunkId{streamId=<*>, chunkIndex=<*>}, buffer=FileSegmentManagedBuffer{file=<*>, offset=<*>, length=<*>}} to <*>; closing connection", "Error sending result ChunkFetchSuccess{streamChunkId=<*>, buffer=<*>} to <*>; closing connection"),
    ("SparkListenerBus has already stopped! Dropping event SparkListenerBlockUpdated(BlockUpdatedInfo(BlockManagerId(<*>, <*>, <*>,StorageLevel(<*>, <*>, <*>, <*>, <*>))", "SparkListenerBus has already stopped! Dropping event <*>"),
    ("Submitting <*> missing tasks from ResultStage <*> (<*> at <*> at <*>)", "Submitting <*> missing tasks from ResultStage <*> (<*> at <*>)"),
    ("<*> more authentication failure; logname= uid=<*> euid=<*> tty=<*> ruser= rhost=<*>", "<*> more authentication failure; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*>"),
    ("[<*>]: Failed to bring port to ACTIVE for node=<*>, port= <*>, no response", "[<*>]: Failed to bring port to ACTIVE for node=<*>, port=<*>, no response"),
    ("[<*>]: Failed to bring port to ACTIVE for node=<*>, port= <*>, mad status <*>", "[<*>]: Failed to bring port to ACTIVE for node=<*>, port=<*>, mad status <*>"),
    ("[<*>]: Program port state, node=<*>, port= <*>, current state <*>, neighbor node=<*>, port= <*>, current state <*>", "[<*>]: Program port state, node=<*>, port=<*>, current state <*>, neighbor node=<*>, port=<*>, current state <*>"),
    ("[<*>]: Failed to negotiate MTU, op_vl for node=<*>, port= <*>, no response", "[<*>]: Failed to negotiate MTU, op_vl for node=<*>, port=<*>, no response"),
    ("PSU status ( <*> <*> )", "PSU status (<*> <*>)"),
    ("pam_unix(sshd:auth): authentication failure; logname= uid=<*> euid=<*> tty=<*> ruser= rhost=<*> user=<*>", "pam_unix(sshd:auth): authentication failure; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*> user=<*>"),
    ("PAM <*> more authentication failures; logname= uid=<*> euid=<*> tty=<*> ruser= rhost=<*> user=<*>", "PAM <*> more authentication failures; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*> user=<*>"),
    ("authentication failure; logname=<*> uid=<*> euid=<*> tty= ruser= rhost= user=<*>", "authentication failure; logname=<*> uid=<*> euid=<*> tty=<*> ruser=<*> rhost=<*> user=<*>"),
    ("connection from <*> () at <*>", "connection from <*> (<*>) at <*>"),
    ("session opened for user <*> by <*>(uid=<*>)", "session opened for user <*> by <*>"),
    ("Releasing unassigned and invalid container Container: [ContainerId: <*>, NodeId: <*>, NodeHttpAddress: <*>, Resource: <*>, Priority: <*>, Token: Token { kind: <*>, service: <*> }, ]. RM may have assignment issues", "Releasing unassigned and invalid container Container: [ContainerId: <*>, NodeId: <*>, NodeHttpAddress: <*>, Resource: <*>, Priority: <*>, Token: <*>]. RM may have assignment issues"),
    ("Final resource view: name=<*> phys_ram=<*> used_ram=<*> phys_disk=<*> used_disk=<*> total_vcpus=<*> used_vcpus=<*> pci_stats=[]", "Final resource view: name=<*> phys_ram=<*> used_ram=<*> phys_disk=<*> used_disk=<*> total_vcpus=<*> used_vcpus=<*> pci_stats=<*>"),
]

# Rewrites (expression, replacement), each repeated until it finds nothing more.
REWRITES = [
    (r"<\*> <\*>-<\*>-<\*> <\*> <\*> \(<\*>\) --> <\*> <\*>-<\*>-<\*> <\*> <\*> \(<\*>\)", "<*>"),
    (r"\( <\*>,", "(<*>,"),
    (r"\{ <\*> <\*> \}", "<*>"),
    (r'"<\*>"', "<*>"),
    (r"<\*> [MKG]B", "<*>"),
    (r"<\*>\$<\*>", "<*>"),
    (r"\(<\*>\)", "<*>"),
    (r"\{ <\*> \}", "<*>"),
    (r"BP-<\*>", "<*>"),
    (r"[a-zA-Z]+\.<\*>", "<*>"),
    (r"\.\.<\*>", ".<*>"),
    (r"http://<\*>", "<*>"),
    (r"<\*>\)", "<*>"),
    (r"\(<\*>", "<*>"),
    (r"<\*>\+<\*>", "<*>"),
    (r"<\*>:", "<*>"),
    (r"\+<\*>", "<*>"),
    (r"\{<\*>\}", "<*>"),
    (r"<\*>-", "<*>"),
    (r"\[<\*>\]", "<*>"),
    (r"\[<\*>", "<*>"),
    (r"<\*>\]", "<*>"),
    (r"<\*>\.<\*>", "<*>"),
    (r"'<\*>'", "<*>"),
    (r"<\*>'", "<*>"),
    (r"'<\*>", "<*>"),
    (r"<\*>,", "<*>"),
    (r"<\*>#", "<*>"),
    (r"#<\*>", "<*>"),
    (r"<\*>;", "<*>"),
    (r"<\*> \]", "<*>"),
    (r"<\*>\.", "<*>"),
    (r"<\*>-<\*>", "<*>"),
    (r"<\*>/", "<*>"),
    (r"<\*> <ok>", "<*>"),
    (r"<\*>:", "<*>"),
    (r"<\*>/<\*>", "<*>"),
    (r"<\*>##<\*>", "<*>"),
    (r"<\*> <\*>", "<*>"),
    (r"<\*><\*>", "<*>"),
]


def rewrite(template: str | None) -> str | None:
    """A template after all rewrites."""
    if template is None:
        return None
    for pattern, to in _COMPILED:
        found = 1
        while found:
            template, found = pattern.subn(to, template)
    return template


_COMPILED = [(re.compile(p), to) for p, to in REWRITES]


def _rewritten(templates: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in templates:
        yield part.map(rewrite, na_action="ignore")


_rewritten.__annotations__ = {"templates": Iterator[pd.Series], "return": Iterator[pd.Series]}


def rewritten(template: str | Column) -> Column:
    """``rewrite`` over a column; used on the template dimension only."""
    return F.pandas_udf(_rewritten, "string")(template)
