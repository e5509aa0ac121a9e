"""SQL for the scores that need the weighted and the matching-block ratio: both worked out step by step from their rules."""

from __future__ import annotations

from concord.operators import confidence as co
from concord.operators import names as na
from concord.operators import signals as si
from concord.plans.checks import check, half_up
from concord.plans.matching_plans import _addr, _exact, _host_trust, _jw, _mail, _n, _phonetic_ctes, _trust
from concord.sources.shaped import shaped, spread


def sequence_cte(source: str) -> str:
    """(a, b, ratio) of the different texts of ``source``: the longest block, then the stretches before and behind it."""
    return f"""WITH RECURSIVE stretches AS (
      SELECT DISTINCT a, b, 0::BIGINT AS found, a AS x, b AS y FROM {source} WHERE a <> '' AND b <> '' AND a <> b
      UNION ALL
      SELECT a, b, part.found, part.x, part.y FROM (
        SELECT a, b, unnest([{{'found': -best.k, 'x': substr(x, 1, best.i - 1), 'y': substr(y, 1, best.j - 1)}},
          {{'found': 0::BIGINT, 'x': substr(x, best.i - best.k), 'y': substr(y, best.j - best.k)}}]) AS part
        FROM (SELECT *, list_min(flatten([[{{'k': -k, 'i': i, 'j': strpos(y, substr(x, i, k))}} FOR k IN range(1, len(x) - i + 2)
          IF strpos(y, substr(x, i, k)) > 0] FOR i IN range(1, len(x) + 1)])) AS best FROM stretches)
        WHERE best IS NOT NULL)
    ) SELECT a, b, 2e0 * sum(found)::BIGINT / (len(a) + len(b)) AS ratio FROM stretches GROUP BY a, b"""


def sequence(a: str, b: str, found: str) -> str:
    """Ratio of two texts, where ``found`` is that of the CTE; two blank texts are equal."""
    return f"CASE WHEN {a} = {b} THEN 1e0 WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE {found} END"


def _common(x: str, y: str) -> str:
    """Longest common subsequence: for each character of ``y`` the places in ``x``, folded over a row of bits (61 at most)."""
    full = f"((1::BIGINT << len({x})) - 1)"
    places = f"coalesce(list_sum([1::BIGINT << (p - 1) FOR p IN range(1, len({x}) + 1) IF substr({x}, p, 1) = c]), 0)::BIGINT"
    return (f"(len({x}) - bit_count(list_reduce([{full}] || [{places} FOR c IN string_split({y}, '')], "
            f"LAMBDA s, h: ((s + (s & h)) | (s - (s & h))) & {full})))")


def weighted_cte(source: str) -> str:
    """(a, b, ratio) of the different texts of ``source``, for texts of one word: the plain ratio, or that of the best window."""
    return f"""SELECT a, b, round(greatest(200e0 * {_common('a', 'b')} / (len(a) + len(b)), CASE WHEN spread >= 1.5 THEN CASE WHEN spread <= 8 THEN 0.9e0 ELSE 0.6e0 END
        * list_max([200e0 * {_common('short', 'w')} / (len(short) + len(w)) FOR w IN
          [substr(long, greatest(t - len(short), 0) + 1, least(t, len(long)) - greatest(t - len(short), 0)) FOR t IN range(1, len(long) + len(short))]]) ELSE 0e0 END) / 100, 4) AS ratio
      FROM (SELECT *, greatest(len(a), len(b)) / least(len(a), len(b)) AS spread, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short,
        CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM (SELECT DISTINCT a, b FROM {source} WHERE a <> '' AND b <> '' AND a <> b))"""


def _mailed(a: str, b: str, found: str, host_a: str, host_b: str) -> str:
    near = f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 WHEN {a} = {b} THEN 1e0 ELSE {found} END"
    return f"least(({near}) * least({_host_trust(host_a)}, {_host_trust(host_b)}), 1e0)"


def _compact(c: str) -> str:
    return f"regexp_replace({_mail(c)}, '[^a-z0-9@ ]+', '', 'g')"


def _either(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ")" if len(names) > 1 else names[0]


def _both(make) -> tuple[str, str]:
    return make("a"), make("b")


def _text(*names: str):
    """Columns of either side that may lack on one; the first that says something."""
    return lambda s: _either(*[n.replace("@", f"{s}_") for n in names])


def score_ctes(table: str, texts: dict[str, tuple[str, str]], mails: dict[str, tuple[str, str]], full: bool = False) -> dict[str, str]:
    """Stages up to ``m``, a pair table with its texts and mail similarities. ``texts`` and ``mails`` name two columns each."""
    picked = [f"{x} AS a_{k}_, {y} AS b_{k}_" for k, (x, y) in texts.items()]
    picked += [f"{x} AS a_{k}_raw, {y} AS b_{k}_raw, {_compact(f'({x})')} AS a_{k}_, {_compact(f'({y})')} AS b_{k}_" for k, (x, y) in mails.items()]
    ctes = {"n": f"SELECT *, {', '.join(picked)} FROM {table}"}
    joins = ""
    for k in mails:
        ctes[f"asked_{k}"] = f"SELECT a_{k}_ AS a, b_{k}_ AS b FROM n"
        ctes[f"wr_{k}"] = weighted_cte(f"asked_{k}")
        joins += f" LEFT JOIN wr_{k} ON wr_{k}.a = a_{k}_ AND wr_{k}.b = b_{k}_"
    if full:
        ctes["asked_full"] = "SELECT a_full_ AS a, b_full_ AS b FROM n"
        ctes["sr"] = sequence_cte("asked_full")
        joins += " LEFT JOIN sr ON sr.a = a_full_ AND sr.b = b_full_"
    scores = ", ".join(_mailed(f"a_{k}_", f"b_{k}_", f"wr_{k}.ratio", f"a_{k}_raw", f"b_{k}_raw") + f" AS {k}_score" for k in mails)
    scores += f", {sequence('a_full_', 'b_full_', 'sr.ratio')} AS name_seq_score" if full else ""
    ctes["m"] = f"SELECT n.*, {scores} FROM n{joins}"
    return ctes


def _scores(table: str, texts: dict[str, tuple[str, str]], mails: dict[str, tuple[str, str]], body: str, full: bool = False) -> str:
    return check([table], body, score_ctes(table, texts, mails, full))


def _columns(total: str) -> str:
    return f"SELECT pair_id, {half_up(total, 6)} AS entity_score, {half_up(total, 2)} AS match_score, name_score, address_score, " \
        f"{half_up('email_score', 6)} AS email_score, source_score"


def _two_names(first: tuple[str, str], last: tuple[str, str]) -> str:
    return f"round({_jw(*first)} * 0.4e0 + {_jw(*last)} * 0.6e0, 4)"


_MATCH = {
    "first": _both(lambda s: _n(f"{s}_first_name")), "last": _both(lambda s: _n(f"{s}_last_name")), "address": _both(lambda s: _addr(f"{s}_address")),
    "full": _both(lambda s: f"lower(trim(coalesce({s}_first_name, '') || ' ' || coalesce({s}_last_name, '')))"),
}
_SOURCE = f"{_trust('a_source_system', 'b_source_system')} AS source_score"
_NAMES = f"{_two_names(('a_first_', 'b_first_'), ('a_last_', 'b_last_'))} AS name_score"
_ADDRESS = f"{_jw('a_address_', 'b_address_')} AS address_score"

_CUSTOMER = f"""{_columns('''CASE WHEN dob = 1 AND address_score >= 0.95e0 AND name_seq_score >= 0.85e0 THEN greatest(total, 0.82e0)
      WHEN dob = 1 AND name_seq_score >= 0.9e0 THEN greatest(total, 0.78e0) ELSE total END''')}
  FROM (SELECT *, name_seq_score * 0.25e0 + email_score * 0.15e0 + address_score * 0.2e0 + dob * 0.25e0 + member * 0.1e0 + source_score * 0.05e0 AS total
    FROM (SELECT *, {_NAMES}, {_ADDRESS}, {_exact('a_dob', 'b_dob')} AS dob, {_exact('a_member_id', 'b_member_id')} AS member, {_SOURCE} FROM m))"""

_OTHER = half_up("name_score * 0.3e0 + email_score * 0.25e0 + address_score * 0.2e0 + dob * 0.15e0 + member * 0.1e0", 2)
_GENERIC = f"""{_columns('total')} FROM (SELECT *, {_OTHER} AS total
    FROM (SELECT *, {_NAMES}, {_ADDRESS}, {_exact('a_dob', 'b_dob')} AS dob, {_exact('a_member_id', 'b_member_id')} AS member, {_SOURCE} FROM m))"""

_SUPPLIER = f"""{_columns('''CASE WHEN id = 1 AND tax = 1 THEN greatest(total, 0.98e0) WHEN id = 1 THEN greatest(total, 0.94e0)
      WHEN tax = 1 THEN greatest(total, 0.9e0) ELSE total END''')}
  FROM (SELECT *, {half_up("id * 0.4e0 + tax * 0.25e0 + name_score * 0.1e0 + email_score * 0.15e0 + address_score * 0.05e0 + source_score * 0.05e0", 2)} AS total
    FROM (SELECT *, {_jw('a_first_', 'b_first_')} AS name_score, {_ADDRESS}, {_exact('a_id_', 'b_id_')} AS id, {_exact('a_tax_id', 'b_tax_id')} AS tax, {_SOURCE} FROM m))"""

_PATIENT = f"""{_columns('''least(CASE WHEN pid >= 0.9e0 AND dob = 1 AND name_score >= 0.9e0 AND address_score >= 0.95e0 THEN greatest(0.9e0, least(total, 0.92e0))
      WHEN pid >= 0.9e0 AND dob = 1 AND name_score >= 0.85e0 THEN greatest(0.86e0, least(total, 0.9e0)) ELSE total END, 0.92e0)''')}
  FROM (SELECT *, pid * 0.3e0 + human * 0.05e0 + dob * 0.2e0 + name_score * 0.2e0 + address_score * 0.15e0 + email_score * 0.1e0 + source_score * 0.1e0 AS total
    FROM (SELECT *, {_NAMES}, {_ADDRESS}, {_exact('a_born_', 'b_born_')} AS dob, {_SOURCE},
      CASE WHEN {_n('a_human_id')} = '' OR {_n('b_human_id')} = '' THEN 0.5e0 ELSE {_exact('a_human_id', 'b_human_id')} END AS human,
      CASE WHEN a_pid_ <> '' AND a_pid_ = b_pid_ THEN 1e0 WHEN split_part(a_pid_, '-', 1) <> '' AND split_part(a_pid_, '-', 1) = split_part(b_pid_, '-', 1) THEN 0.9e0
        ELSE {_jw('a_pid_', 'b_pid_')} END AS pid FROM m))"""

_BOOST = """CASE WHEN provider_email_score >= 1 AND name_score >= 0.85e0 AND address_score >= 0.9e0 THEN 0.15e0 WHEN name_score >= 0.9e0 AND address_score >= 0.9e0 THEN 0.1e0
  WHEN provider_email_score >= 1 AND name_score >= 0.8e0 THEN 0.08e0 ELSE 0e0 END"""
_PROVIDER = f"""{_columns(f'CASE WHEN scored THEN least(total + {_BOOST}, 1e0) ELSE {_OTHER} END')}
  FROM (SELECT *, pid * 0.25e0 + npi * 0.25e0 + name_score * 0.1e0 + provider_email_score * 0.1e0 + address_score * 0.2e0 + specialty * 0.05e0 + source_score * 0.03e0 + 0.02e0 AS total
    FROM (SELECT *, CASE WHEN scored THEN {_jw('a_joined_', 'b_joined_')} ELSE {_two_names(('a_first_', 'b_first_'), ('a_last_', 'b_last_'))} END AS name_score,
      CASE WHEN scored THEN {_jw('a_own_', 'b_own_')} ELSE {_jw('a_address_', 'b_address_')} END AS address_score, {_exact('a_provider_id', 'b_provider_id')} AS pid,
      {_exact('a_npi', 'b_npi')} AS npi, {_jw('a_spec_', 'b_spec_')} AS specialty, {_exact('a_named_', 'b_named_')} AS member, 0e0 AS dob, {_SOURCE}
      FROM (SELECT *, {_n('a_provider_email_raw')} <> '' AND {_n('b_provider_email_raw')} <> '' AS scored FROM m)))"""

_normal = lambda c: f"nullif(trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z\\s\\-'']', '', 'g'), '\\s+', ' ', 'g')), '')"
_LEVEL = "CASE WHEN na IS NULL OR nb IS NULL THEN 'UNKNOWN' WHEN na = nb OR score >= 0.97e0 THEN 'EXACT' WHEN score >= 0.82e0 THEN 'SIMILAR' ELSE 'DIFFERENT' END"
_NICKNAMES = ", ".join(f"'{p}'" for p in na.NICKNAME_PAIRS)

_SUPPLIER_TEXTS = {
    "first": (_n("a_supplier_name"), _n(_either("b_supplier_name", "b_first_name"))), "address": _both(lambda s: _addr(f"{s}_supplier_address")),
    "id": _both(_text("@supplier_id", "@member_id")),
}
_SUPPLIER_MAILS = {"email": ("a_contact_email", _either("b_contact_email", "b_email"))}


def _banded(*steps: tuple[float, str]) -> str:
    return "CASE " + " ".join(f"WHEN score >= {floor}e0 THEN '{word}'" for floor, word in steps) + " ELSE 'DIFFERENT' END"


def _quoted(c: str, missing: str = "None") -> str:
    return f"chr(39) || coalesce({c}, '{missing}') || chr(39)"


def _compared(what: str, a: str, b: str) -> str:
    return f"'{what} ' || {a} || ' and ' || {b} || '.'"


_PLAIN = _banded((0.95, "EXACT"), (0.7, "SIMILAR"), (0.5, "FUZZY"))
_GRADED = _banded((0.95, "EXACT"), (0.8, "STRONG"), (0.6, "FUZZY"))
_LEVELS = _banded((0.99, "EXACT"), (0.9, "SIMILAR"), (0.7, "FUZZY"))
_SYSTEM = lambda s: _quoted(f"nullif({s}_source_system, '')", "UNKNOWN")
# What is said of each signal of a supplier pair: its score, its band, and the sentence.
_SAID = {
    "supplier_id_match": (_exact("a_id_", "b_id_"), _PLAIN, _compared("Compared Supplier IDs", _quoted("a_id_"), _quoted("b_id_"))),
    "tax_id_match": (_exact("a_tax_id", "b_tax_id"), _PLAIN, _compared("Compared tax IDs", _quoted("a_tax_id"), _quoted("b_tax_id"))),
    "name_similarity": (_jw("a_first_", "b_first_"), _PLAIN, _compared(
        "Compared name pairs", "chr(39) || coalesce(a_supplier_name, '') || ' ' || chr(39)", f"chr(39) || coalesce({_either('b_supplier_name', 'b_first_name')}, '') || ' ' || chr(39)")),
    "address_similarity": ("address_score", _PLAIN, "'Supplier addresses evaluated using Jaro-Winkler fuzzy matching. Confidence score: ' || printf('%.2f', "
                           + half_up("address_score", 2) + f") || ' (' || {_GRADED} || ').'"),
    "contact_email_match": ("email_score", _LEVELS, f"""CASE WHEN coalesce(a_email_raw, '') = '' OR coalesce(b_email_raw, '') = '' THEN 'Supplier contact email missing on one or both records.'
      WHEN {_n('a_email_raw')} = {_n('b_email_raw')} THEN 'Supplier contact email values match exactly.' ELSE 'Supplier contact email values partially align or differ.' END"""),
    "source_trust": (_trust("a_source_system", "b_source_system"), _PLAIN, _compared("Source trust evaluated for", _SYSTEM("a"), _SYSTEM("b"))),
}
_SUPPLIER_SAID = " UNION ALL ".join(
    f"SELECT pair_id, '{name}' AS signal_name, {half_up('score', 4)} AS signal_score, {band} AS signal_band, {text} AS detail FROM (SELECT *, {score} AS score FROM told)"
    for name, (score, band, text) in _SAID.items())

CHECKS = {
    "signal_details": check(["supplier_pairs"], _SUPPLIER_SAID, {
        **score_ctes("supplier_pairs", _SUPPLIER_TEXTS, _SUPPLIER_MAILS), "told": f"SELECT *, {_ADDRESS} FROM m"}),
    "email_score": _scores("match_pairs", {}, {"email": _both(lambda s: f"{s}_email")}, f"""SELECT pair_id, {half_up('email_score', 4)} AS email_score,
      CASE WHEN email_score >= 0.99e0 THEN 'EXACT' WHEN email_score >= 0.9e0 THEN 'SIMILAR' WHEN email_score >= 0.7e0 THEN 'FUZZY' ELSE 'DIFFERENT' END AS email_match_level FROM m"""),
    "score_customer": _scores("match_pairs", _MATCH, {"email": _both(lambda s: f"{s}_email")}, _CUSTOMER, full=True),
    "score_generic": _scores("match_pairs", _MATCH, {"email": _both(lambda s: f"{s}_email")}, _GENERIC),
    "score_supplier": _scores("supplier_pairs", _SUPPLIER_TEXTS, _SUPPLIER_MAILS, _SUPPLIER),
    "score_patient": _scores("patient_pairs", {
        "first": (_n(_either("a_patient_first_name", "a_first_name")), _n("b_first_name")), "last": (_n(_either("a_patient_last_name", "a_last_name")), _n("b_last_name")),
        "address": (_addr("a_address"), _addr("b_patient_address")), "born": (_either("a_patient_dob", "a_dob"), "b_dob"), "pid": _both(lambda s: _n(f"{s}_patient_id")),
    }, {"email": ("a_email", "b_patient_email")}, _PATIENT),
    "score_provider": _scores("provider_pairs", {
        "joined": _both(lambda s: f"lower(trim(coalesce({s}_provider_first_name, '') || ' ' || coalesce({s}_provider_last_name, '')))"),
        "first": _both(lambda s: _n(f"{s}_first_name")), "last": _both(lambda s: _n(f"{s}_last_name")),
        "own": _both(lambda s: _n(_either(f"{s}_provider_address", f"{s}_address"))), "address": _both(lambda s: _addr(f"{s}_address")),
        "spec": _both(lambda s: _n(f"{s}_specialty")), "named": _both(lambda s: f"coalesce(nullif(trim({s}_provider_id), ''), nullif(trim({s}_npi), ''), '')"),
    }, {"email": _both(lambda s: f"{s}_email"), "provider_email": _both(_text("@provider_email", "@email"))}, _PROVIDER),
    "name_compare": check(["match_pairs"], f"""SELECT pair_id, na AS normalized_a, nb AS normalized_b, score AS similarity_score, {_LEVEL} AS match_level,
        key_a AS phonetic_key_a, key_b AS phonetic_key_b, coalesce(nick AND nb IS NOT NULL, false) AS nickname_match,
        CASE WHEN na IS NULL OR nb IS NULL THEN 'One or both names are missing.' WHEN na = nb THEN 'Names match exactly after normalization.'
          ELSE concat_ws('; ', CASE WHEN nick THEN 'Known nickname or common name variant detected.' END, CASE WHEN alike THEN 'Names are phonetically similar.' END,
            CASE WHEN one_off THEN 'Names differ by a minor spelling variation.' END) END AS findings,
        CASE WHEN na IS NULL OR nb IS NULL THEN 'Name comparison unavailable.' WHEN na = nb THEN 'Names match exactly.'
          WHEN score >= 0.97e0 THEN 'Names are effectively identical after normalization.' WHEN score >= 0.82e0 THEN 'Names appear to be a likely spelling or nickname variation.'
          ELSE 'Names do not strongly support a match.' END AS insight
      FROM (SELECT *, CASE WHEN na IS NULL OR nb IS NULL THEN 0e0 WHEN na = nb THEN 1e0 ELSE {half_up('''least(1e0, greatest(ratio, CASE WHEN nick THEN 0.92e0 ELSE 0e0 END,
          CASE WHEN alike THEN 0.88e0 ELSE 0e0 END, CASE WHEN one_off THEN 0.9e0 ELSE 0e0 END))''', 4)} END AS score
        FROM (SELECT *, least(na, nb) || '|' || greatest(na, nb) IN ({_NICKNAMES}) AS nick, coalesce(key_a = key_b, false) AS alike,
          abs(len(na) - len(nb)) <= 1 AND ratio >= 0.85e0 AS one_off
          FROM (SELECT ph3.*, coalesce(sr.ratio, 0e0) AS ratio FROM ph3 LEFT JOIN sr ON sr.a = na AND sr.b = nb)))""",
        {"normal": f"SELECT pair_id, {_normal('a_first_name')} AS na, {_normal('b_first_name')} AS nb FROM match_pairs",
         **_phonetic_ctes("normal", {"key_a": "na", "key_b": "nb"}, "pair_id, na, nb"),
         "asked": "SELECT na AS a, nb AS b FROM normal", "sr": sequence_cte("asked")}),
}


def _details(s, d):
    """The signals of supplier pairs with their sentences, one row each."""
    df = co.with_signal_packets(si.pair_signals(spread(shaped(s, d, "supplier_pairs"))))
    return co.one_row_per_entry(df, "signal_packets").select("pair_id", "signal_name", "signal_score", "signal_band", "detail")


QUERIES = {"signal_details": _details}
