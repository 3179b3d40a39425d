"""Column functions over command text.  All are built-in expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ENTER_MARKS = ("<cr>", "<return>", "<enter>", "<[enter]>", "[enter]")
SECRET_WORDS = ("password", "secret", "community", "pre-shared", "psk", "key", "key-string", "authentication-key", "shared-key", "private-key", "certificate", "cipher")
NEGATIONS = ("no", "undo", "default")

#: Escape sequences of terminals.
_ANSI = r"\x1b(?:[@-_][0-?]*[ -/]*[@-~]|\][^\x07]*(?:\x07|\x1b\\))"


def one_spaced(text: Column) -> Column:
    """Trimmed, every run of white space one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    return F.filter(F.split(one_spaced(text), " "), lambda w: w != "")


def is_shouted(token: Column) -> Column:
    """Cased letters, all of them upper case."""
    return (F.upper(token) == token) & (F.lower(token) != token)


def option_kind(token: Column) -> Column:
    """``cr`` for an enter mark, ``parameter`` for a placeholder, else ``keyword``."""
    placeholder = token.rlike(r"^<[\s\S]*>$") | is_shouted(token) | token.rlike(r"[\[\]{}|]")
    return F.when(F.lower(token).isin(*ENTER_MARKS), "cr").when(placeholder, "parameter").otherwise("keyword")


def stem(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9]+$", "")


def folded(text: Column) -> Column:
    """Every run of digits as a star: the shape that instances of a thing share."""
    return F.regexp_replace(text, "[0-9]+", "*")


def skeleton(text: Column) -> Column:
    """Words with a digit and words over 24 characters replaced by ``<value>``."""
    return F.array_join(F.transform(words(text), lambda w: F.when(w.rlike(r"[0-9]") | (F.length(w) > 24), "<value>").otherwise(w)), " ")


def secrets_blanked(line: Column) -> Column:
    """A line cut after its first secret word that isn't its last word, indent kept."""

    def cut(tokens: Column) -> Column:
        places = F.transform(tokens, lambda w, i: F.when((i < F.size(tokens) - 1) & F.lower(w).isin(*SECRET_WORDS), i + 1))
        first = F.array_min(places)
        kept = F.concat(F.regexp_extract(line, r"^(\s*)", 1), F.array_join(F.slice(tokens, 1, first), " "), F.lit(" <redacted>"))
        return F.when(first.isNotNull(), kept).otherwise(line)

    return F.transform(F.array(words(line)), cut)[0]  # the words are named once


def edges_trimmed(output: Column, command: Column) -> Column:
    """An answer without the blank lines and echoes of the command before it, and without the blank
    lines and prompts after it.  An echo is the command alone or after a prompt."""
    lead = lambda x: F.rtrim(F.left(x, F.length(x) - F.length(command)))
    echo = lambda x: (F.trim(x) == command) | ((command != "") & F.endswith(F.trim(x), command) & lead(F.trim(x)).rlike(r"[#>$]$"))
    def kept(lines: Column) -> Column:
        first = F.array_min(F.transform(lines, lambda x, i: F.when(~((F.trim(x) == "") | echo(x)), i)))
        last = F.array_max(F.transform(lines, lambda x, i: F.when(~((F.trim(x) == "") | F.trim(x).rlike(r"^\S*[>#$]\s*$")), i)))
        between = lambda e: F.when(e["first"].isNull() | e["last"].isNull() | (e["last"] < e["first"]), "").otherwise(F.array_join(F.slice(lines, e["first"] + 1, F.greatest(e["last"] - e["first"] + 1, F.lit(0))), "\n"))
        return F.transform(F.array(F.struct(first.alias("first"), last.alias("last"))), between)[0]

    return F.transform(F.array(F.split(output, r"\r\n|\r|\n")), kept)[0]  # cleaned and split once, not for every line


#: Lines that carry a secret, labels of what identifies a device, hardware addresses.
_SECRET_LINE = r"(?imdU)^\s*.*\b(?:password|secret|community|pre-shared|psk|snmp-server\s+(?:user|community)|key(?:-string)?|md5|hmac|authentication-key|shared-key|private-key|certificate)\b.*$"
_IDENTITY = r"(?imdU)^([^:]*\b(?:serial|s/n|sn|system\s+id|chassis\s+id|host\s*name|hostname|device\s+name|mac\s+address|base\s+ethernet)\b[^:]*:)\s*\S.*$"
_HARDWARE = r"(?U)\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b|\b(?:[0-9a-fA-F]{4}\.){2}[0-9a-fA-F]{4}\b"
#: Fixed value: a prompt is a host, a mode in brackets and a level mark.
_PROMPT = r"(?U)^[\w.-]+?(\([^)]*\))?([#>$])\s*$"


def identity_redacted(text: Column) -> Column:
    """Lines that carry a secret, what follows the label of an identity, and hardware addresses
    replaced by marks."""
    text = F.regexp_replace(text, _SECRET_LINE, "<redacted line>")
    return F.trim(F.regexp_replace(F.regexp_replace(text, _IDENTITY, "$1 <redacted>"), _HARDWARE, "<redacted>"))


def fingerprint(prompt: Column) -> Column:
    """Mode in brackets with digits as stars, and the level mark, of a prompt line; null if none."""
    bare = F.trim(prompt)
    return F.when(bare.rlike(_PROMPT), F.concat(folded(F.regexp_extract(bare, _PROMPT, 1)), F.regexp_extract(bare, _PROMPT, 2)))


def fingerprint_of(output: Column) -> Column:
    """Fingerprint of the last prompt in an output; null if it holds none."""
    prompts = F.filter(F.split(F.regexp_replace(output, "\r", ""), "\n"), lambda x: F.trim(x).rlike(_PROMPT))
    return fingerprint(F.try_element_at(prompts, F.lit(-1)))


def context_key(fingerprint: Column, entry_path: Column) -> Column:
    """Identity of a context: fingerprint and last entry step, digits folded and bare stars dropped."""
    last = F.coalesce(F.element_at(F.when(F.size(entry_path) > 0, entry_path), -1), F.lit(""))
    return F.concat_ws(" ", F.coalesce(fingerprint, F.lit("")), F.array_join(F.filter(words(folded(last)), lambda w: w != "*"), " "))


def _bare_command(line: Column) -> Column:
    return one_spaced(F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), r"^`+|`+$", ""))


def _verdict(c: Column) -> Column:
    return (
        F.when(c == "", "empty").when(F.octet_length(c) > 512, "too long").when(~c.rlike(r"^[\x20-\x7e]*$"), "not printable ascii").when(c.contains("?"), "question")
        .when(c.rlike(r"[.,:;]$"), "sentence").when(c.rlike(r"^(?:sudo|ssh|telnet) "), "host tool").when(~c.rlike(r"^[a-z][a-z0-9-]*(?: [^ ]+)*$"), "not a command")
        .when(c.rlike(r"->|=>"), "arrow").when(F.size(F.split(c, " ")) > 32, "too many words").otherwise("ok")
    )


def command_verdict(line: Column) -> Column:
    """``ok``, or why a line is no command; the first reason that holds."""
    return F.transform(F.array(_bare_command(line)), _verdict)[0]  # the bare line is made once


def normal_command(line: Column) -> Column:
    """The command a line holds, one-spaced; null where ``command_verdict`` isn't ok."""
    return F.transform(F.array(_bare_command(line)), lambda c: F.when(_verdict(c) == "ok", c))[0]


def command_form(line: Column) -> Column:
    """A syntax line without a leading non-Latin heading and without a dashed remark; null if such
    letters or an ellipsis remain."""
    bare = F.regexp_replace(F.trim(line), r"^[^:]*[\u0400-\u04ff][^:]*:\s+", "")
    bare = F.trim(F.regexp_replace(bare, "\\s[\u2013\u2014]\\s.*$", ""))
    return F.when((bare != "") & ~bare.rlike(r"[\u0400-\u04ff\u2026]|\.\.\."), bare)


def is_option_flag(token: Column) -> Column:
    return token.rlike(r"^-[^0-9]")


def is_safe_fragment(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x3e\x40-\x7e]+$")


#: Verbs that end a session, change what a device holds or leave its command line; and
#: those that name a view which a session steps into and out of again.
DENIED_PROBES = (
    "reboot reload restart halt shutdown poweroff erase format delete clear write copy save restore upgrade update boot install flush "
    "reset commit rollback request startup schedule backup activate deactivate apply revert zeroize zeroise renew refresh kill terminate disconnect free fixdisk mkdir rmdir rename move undelete patch load execute test "
    "logout exit quit end disable ping traceroute tracert telnet ssh monitor debug terminal screen-length more language "
    "diagshell diagnose produce shell bash sh start-shell system-shell vtysh python tclsh "
    "line username user login authentication aaa service management sshd telnetd ftpd tftpd"
).split()
VIEW_VERBS = "configure config system-view interface vlan vrf router bridge-domain policy-map class-map class route-map address-family key-chain template peer-group line".split()


def is_probe_allowed(command: Column, denied: list[str] = DENIED_PROBES) -> Column:
    """Neither empty, nor a negation, nor holding a denied word anywhere."""
    low = F.transform(words(command), lambda w: F.lower(w))
    return (F.size(low) > 0) & ~F.coalesce(F.get(low, F.lit(0)).isin(*NEGATIONS), F.lit(False)) & ~F.arrays_overlap(low, F.array(*[F.lit(d.lower()) for d in denied or ["\x00"]]))


def parameter_sample(token: Column, samples: dict[str, str]) -> Column:
    """What to type for a placeholder: its sample, that of any letter case, or the low end of a
    numeric range; null if there is none."""
    exact, loose = token, F.lower(token)
    if samples:
        table = F.create_map(*[F.lit(x) for kv in samples.items() for x in kv])
        lower = F.create_map(*[F.lit(x) for k, v in {k.lower(): v for k, v in samples.items()}.items() for x in (k, v)])
        known = F.coalesce(table[exact], lower[loose])
    else:
        known = F.lit(None).cast("string")
    low = F.regexp_extract(token, r"^<\(?(-?\d+)\s*(?:-|\.\.)\s*-?\d+\)?>$", 1)
    return F.coalesce(known, F.when(low != "", low))


def numeric_domain(text: Column) -> Column:
    """The one range ``lo-hi``, ``lo..hi``, ``from lo to hi`` a description names, as ``lo-hi``;
    null if it names none or several different ones.  Runs joined by slashes are no ranges."""
    bounds = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d)[ \u00a0](?=\d{3}\b)", ""), F.lit(r"(?i)(?<![\w/.-])(?:from\s+)?(-?\d+)\s*(?:-|\u2013|\.\.\.?|to)\s*(-?\d+)(?![\w/]|\.\d|-\d)"), 0)
    pairs = F.array_distinct(F.transform(bounds, lambda b: F.concat_ws("-", F.regexp_extract(b, r"(-?\d+)", 1), F.regexp_extract(b, r"(?:-|\u2013|\.|to)\s*(-?\d+)$", 1))))
    return F.when(F.size(pairs) == 1, F.get(pairs, F.lit(0)))


def placeholder(name: Column, description: Column) -> Column:
    """``<lo-hi>`` where the description names one range and no address, else ``<name>``."""
    domain = F.when(~F.lower(description).rlike(r"address|mask"), numeric_domain(description))
    return F.when(domain.isNotNull(), F.concat(F.lit("<"), domain, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def safe_name(text: Column) -> Column:
    """A file name: lower case, other characters as dashes, none at the ends, ``block`` if empty."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w-]", "-"), "^-+|-+$", "")
    return F.when(bare == "", "block").otherwise(bare)


def block_label(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def head_word(text: Column) -> Column:
    return F.lower(F.coalesce(F.get(words(text), F.lit(0)), F.lit("")))


def duration_badge(seconds: Column) -> Column:
    """``<1s``, ``~45s``, ``~2m`` or ``~2m30s``; halves of seconds go to the even side."""
    total = F.bround(seconds).cast("long")
    minutes, rest = F.floor(total / 60), total % 60
    text = F.when(minutes == 0, F.format_string("~%ds", rest)).when(rest == 0, F.format_string("~%dm", minutes)).otherwise(F.format_string("~%dm%02ds", minutes, rest))
    return F.when(seconds < 1, "<1s").otherwise(text)


def _without_backspaces(line: Column) -> Column:
    """A line as typed: each backspace takes the character before it."""
    typed = F.aggregate(F.split(line, ""), F.lit(""), lambda kept, c: F.when(c == "\b", F.left(kept, F.length(kept) - 1)).otherwise(F.concat(kept, c)))
    return F.when(line.contains("\b"), typed).otherwise(line)


def terminal_cleaned(output: Column) -> Column:
    """Without escape sequences, carriage returns and what backspaces took away."""
    plain = F.replace(F.regexp_replace(F.coalesce(output, F.lit("")), _ANSI, ""), F.lit("\r"), F.lit(""))
    return F.when(plain.contains("\b"), F.array_join(F.transform(F.split(plain, "\n"), _without_backspaces), "\n")).otherwise(plain)
