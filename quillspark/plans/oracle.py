"""DuckDB statements of the registered queries, put together from named table expressions."""

from __future__ import annotations

import re

_TOKEN = r"(?i)[0-9a-z]+(?:[._:/\\@+\-''][0-9a-z]+)*"
WORD = r"[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?"
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_TOKEN}')"


def _noise(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '[/.]') THEN 10.0 ELSE 0.0 END + CASE WHEN regexp_matches({c}, '[0-9]') THEN 8.0 ELSE 0.0 END)::DOUBLE"


def partial(c: str) -> str:
    return f"CASE WHEN length({c}) <= 2 THEN {c}[1:1] ELSE {c}[1:greatest(2, least(length({c}) - 1, ceil(length({c}) * 0.6)::INT))] END"


def _q(expr: str) -> str:
    return f"greatest(-32768, least(32767, round_even(({expr}) * 1024.0, 0)::INT))"


def _form(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_BLEND = "{0} * ln(unigram_count + 1.0) + {1} * ln(segment_freq + 1.0) + {2} * entropy + {3} * specificity"

#: Each may use those before it.
CTES: dict[str, str] = {
    "raw": rf"""SELECT doc_id AS doc_ord, list_filter(flatten(list_transform(string_split_regex(text, '{_BREAK}'),
        lambda l: string_split(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)))), lambda s: trim(s) <> '') AS l
        FROM documents WHERE text IS NOT NULL AND text <> ''""",
    "seg": f"""SELECT doc_ord, seg_no, tok FROM (SELECT doc_ord, seg_no, {_tokens('s')} AS tok FROM (SELECT doc_ord, unnest(l) AS s, unnest(range(len(l)))::INT AS seg_no FROM raw)) WHERE len(tok) > 0""",
    "w": "SELECT doc_ord, seg_no, unnest(tok) AS token, unnest(range(len(tok)))::INT AS pos FROM seg",
    "cnt": "SELECT token, count(*) AS unigram_count, count(DISTINCT (doc_ord, seg_no)) AS segment_freq FROM w GROUP BY token",
    "tot": "SELECT (SELECT count(*) FROM seg) AS n_seg, (SELECT count(*) FROM w) AS n_tok",
    "kept": """SELECT cnt.* FROM cnt, tot WHERE n_tok < 100000 OR (unigram_count >= 2 AND (n_seg < 5000 OR segment_freq >= 2 OR unigram_count >= 12))""",
    "vocab": "SELECT (row_number() OVER (ORDER BY unigram_count DESC, token) - 1)::INT AS token_id, token, unigram_count, segment_freq FROM kept",
    "p": "SELECT doc_ord, seg_no, token_id, pos FROM w JOIN vocab USING (token)",
    "s": "SELECT doc_ord, seg_no, list(token_id ORDER BY pos) AS ids FROM p GROUP BY ALL",
    "pa": "SELECT doc_ord, seg_no, ids, unnest(range(len(ids)))::INT AS pos FROM s",
    "g": "SELECT doc_ord, seg_no, pos, n, ids, ids[pos + 1:pos + n] AS gram FROM pa, (VALUES (2), (3), (4)) v(n) WHERE pos + n <= len(ids)",
    "gc": "SELECT gram, n, count(*) AS c, min((doc_ord, seg_no, pos)) AS first FROM g GROUP BY gram, n",
    "bi": "SELECT gram[1] AS l, gram[2] AS r, c FROM gc WHERE n = 2",
    "big": "SELECT coalesce(sum(c), 0)::BIGINT AS t, count(*) AS b FROM bi",
    "ent": "SELECT l AS token_id, sum(-p * ln(p + 1e-12)) AS entropy, count(*) AS followers FROM (SELECT l, c / sum(c) OVER (PARTITION BY l) AS p FROM bi) GROUP BY l",
    "con": "SELECT r AS token_id, count(*) AS continuations FROM bi GROUP BY r",
    "stats": f"""SELECT v.*, coalesce(entropy, 0.0) AS entropy, coalesce(followers, 0) AS followers, coalesce(continuations, 0) AS continuations,
        -ln((coalesce(continuations, 0) + 1.0) / (greatest(1, t) + 1.0)) AS specificity, {_noise('token')} AS noise
        FROM vocab v LEFT JOIN ent USING (token_id) LEFT JOIN con USING (token_id), big""",
    "tt": "SELECT (SELECT sum(unigram_count) FROM vocab)::DOUBLE AS n, (SELECT count(*) FROM vocab) AS v, (SELECT greatest(1, b) FROM big)::DOUBLE AS b",
    "pm": """SELECT gram, any_value(gc.n) AS n, any_value(c) AS c, ln((any_value(c) / any_value(tt.n)) / product(unigram_count / tt.n)) AS pmi,
        bool_or((k = 1 OR k = gc.n) AND regexp_matches(token, '^\\p{L}{1,2}$')) AS weak
        FROM (SELECT *, unnest(gram) AS token_id, unnest(range(1, n + 1)) AS k FROM gc WHERE c >= 2 AND ln(c + 1.0) * n >= 2.0) gc JOIN vocab USING (token_id), tt GROUP BY gram""",
    "cand": "SELECT * FROM pm WHERE pmi >= 0.0 AND (NOT weak OR c >= 8)",
    "pl": "SELECT g.* FROM g WHERE gram IN (SELECT gram FROM cand)",
    "ext": """SELECT gram, max(k) AS most FROM (
        SELECT gram, 'l' AS side, ids[pos] AS o, count(*) AS k FROM pl WHERE pos > 0 GROUP BY ALL UNION ALL
        SELECT gram, 'r', ids[pos + n + 1], count(*) FROM pl WHERE pos + n < len(ids) GROUP BY ALL) GROUP BY gram""",
    "ph": """SELECT (row_number() OVER (ORDER BY c DESC, n, gram) - 1)::INT AS phrase_id, gram AS token_ids, n, c, pmi FROM cand LEFT JOIN ext USING (gram) WHERE coalesce(most, 0) / c <= 0.95""",
    "br": "SELECT gram[1:n - 1] AS head, count(*) AS nx FROM gc GROUP BY head",
    "phb": "SELECT ph.*, ln(coalesce(nx, 0) + 1.0) AS branching FROM ph LEFT JOIN br ON br.head = ph.token_ids[1:n - 1]",
    "post": f"""SELECT prefix, rank, token_id, token, score FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY q DESC, token_id)::INT AS rank FROM (
        SELECT token_id, token, round_even(({_BLEND.format(0.45, '0.20', '0.20', 0.15)}) * 1024.0, 0)::INT AS q, {_q(_BLEND.format('0.40', '0.20', '0.20', '0.20'))} AS score, token[1:k] AS prefix
        FROM (SELECT *, unnest(range(1, least(length(token), 24) + 1)) AS k FROM stats))) WHERE rank <= 64""",
    "te": f"""SELECT key, rank, target_id, c, {_q('0.55 * ln(c + 1.0) + 0.20 * ln(unigram_count + 1.0) + 0.15 * entropy + 0.10 * specificity')} AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first)::INT AS rank FROM (SELECT gram[1:n - 1] AS key, gram[n] AS target_id, c, first FROM gc)) e JOIN stats ON token_id = target_id WHERE rank <= 32""",
    "pe": f"""SELECT key, rank, target_id, e.c, {_q('0.45 * ln(e.c + 1.0) + 0.30 * (ln(ph.c + 1.0) * n) + 0.25 * branching')} AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first)::INT AS rank FROM (
            SELECT ids[pos - k + 1:pos] AS key, phrase_id AS target_id, count(*) AS c, min((doc_ord, seg_no, pos, pl.n)) AS first
            FROM pl JOIN ph ON ph.token_ids = gram, (VALUES (1), (2), (3)) v(k) WHERE pos >= k GROUP BY ALL)) e JOIN phb ph ON phrase_id = target_id WHERE rank <= 16""",
    "dw": f"SELECT doc_id AS prompt_id, regexp_extract_all(lower(text), '{WORD}') AS a, 1 + doc_id % 3 AS k FROM documents WHERE text IS NOT NULL",
    "pr": f"SELECT prompt_id, array_to_string(a[1:m], ' ') || ' ' || {partial('a[m + 1]')} AS text FROM (SELECT prompt_id, a, least(k, least(len(a), 4) - 1) AS m FROM dw WHERE len(a) >= 2)",
    "cp": "SELECT prompt_id, array_to_string(a[1:least(k, least(len(a), 3))], ' ') || ' ' AS text FROM dw WHERE len(a) >= 1",
    "hp": f"SELECT prompt_id, text, tok[1:len(tok) - 1] AS hist, coalesce(tok[len(tok)], '') AS frag FROM (SELECT prompt_id, text, {_tokens('text')} AS tok FROM pr)",
    "hc": f"SELECT prompt_id, text, {_tokens('text')} AS hist, '' AS frag FROM cp",
    "h": "SELECT * FROM hp UNION ALL BY NAME SELECT -1 - prompt_id AS prompt_id, text, hist, frag FROM hc",
    "ht": """SELECT prompt_id, pos, hw.token, token_id, unigram_count AS uc, followers AS fo, continuations AS co
        FROM (SELECT prompt_id, unnest(hist) AS token, unnest(range(1, len(hist) + 1)) AS pos FROM h) hw LEFT JOIN stats USING (token)""",
    "hk": """SELECT prompt_id, sum(ln(CASE WHEN pos = 1 THEN CASE WHEN uc > 0 THEN uc / n ELSE 1 / (n + v) END
            WHEN puc > 0 THEN greatest(coalesce(c, 0) - 0.75, 0) / puc + 0.75 * pfo / puc * cont ELSE cont END + 1e-12)) AS kn
        FROM (SELECT x.*, bi.c, tt.*, CASE WHEN co > 0 THEN co / b ELSE 1 / (b + v) END AS cont FROM (
            SELECT *, lag(token_id) OVER o AS pid, lag(uc) OVER o AS puc, lag(fo) OVER o AS pfo FROM ht WINDOW o AS (PARTITION BY prompt_id ORDER BY pos)) x
            LEFT JOIN bi ON l = pid AND r = x.token_id, tt) GROUP BY prompt_id""",
    "hr": """SELECT prompt_id, avg(CASE WHEN te.key IS NULL THEN 0.0 ELSE 1.0 END) AS ratio FROM (
            SELECT prompt_id, lag(token_id) OVER (PARTITION BY prompt_id ORDER BY pos) AS pid, token_id FROM ht WHERE token_id IS NOT NULL) x
        LEFT JOIN te ON te.key = [pid] AND te.target_id = x.token_id WHERE pid IS NOT NULL GROUP BY prompt_id""",
    "hi": "SELECT prompt_id, list(token_id ORDER BY pos) AS ids FROM ht GROUP BY prompt_id",
    "keys": "SELECT DISTINCT key FROM te UNION SELECT DISTINCT key FROM pe",
}


def _needs(sql: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", sql)}


def statement(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the table expressions that it needs, and ``extra`` ones after them."""
    extra = extra or {}
    want, todo = set(), _needs(body + " ".join(extra.values()))
    while todo:
        n = todo.pop()
        if n not in want:
            want.add(n)
            todo |= _needs(CTES[n]) - want - {n}
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in want] + [f"{n} AS MATERIALIZED ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def backoff(states: str, out: str, by: str, ids: str) -> dict[str, str]:
    """The first key of ``keys`` for each row of ``states``: suffixes after the last unknown, then of the known ones."""
    return {
        f"{out}_k": f"""SELECT {by}, unnest(list_concat([[run[len(run) - k + 1:len(run)], [k]] FOR k IN range(3, 0, -1) IF k <= len(run)], [[known[len(known) - k + 1:len(known)], [k - 10]] FOR k IN range(3, 0, -1) IF k <= len(known)])) AS x
            FROM (SELECT {by}, list_filter({ids}, lambda x: x IS NOT NULL) AS known, {ids}[coalesce(list_max([i FOR i IN range(1, len({ids}) + 1) IF {ids}[i] IS NULL]), 0) + 1:] AS run FROM {states})""",
        out: f"SELECT {by}, arg_max(x[1], x[2][1]) AS key FROM {out}_k WHERE x[1] IN (SELECT key FROM keys) GROUP BY {by}",
    }


def _pair_p(c: str, count: str, followers: str, cont: str) -> str:
    return f"ln((CASE WHEN {count} > 0 THEN greatest(coalesce({c}, 0) - 0.75, 0)::DOUBLE / {count} + 0.75::DOUBLE * {followers} / {count} * {cont} ELSE {cont} END) + 1e-12)"


_EDITS = "CASE WHEN length(frag) < 3 THEN 0 WHEN length(frag) < 6 THEN 1 ELSE 2 END"

#: Edges with what a beam step needs, and the words of phrases.
_EDGES: dict[str, str] = {
    "nm": "SELECT token_id, token, noise, unigram_count AS uc, followers AS fo, CASE WHEN continuations > 0 THEN continuations / b ELSE 1 / (b + v) END AS cont FROM stats, tt",
    "pw": f"""SELECT phrase_id, list(token ORDER BY k) AS words, list(noise ORDER BY k) AS noises, list(lp ORDER BY k) FILTER (k > 1) AS rest FROM (
        SELECT phrase_id, k, x.token, x.noise, {_pair_p('bi.c', 'y.uc', 'y.fo', 'x.cont')} AS lp
        FROM (SELECT phrase_id, unnest(token_ids) AS token_id, unnest(range(1, n + 1)) AS k, unnest(list_concat([NULL], token_ids[1:n - 1])) AS before FROM ph) z
        JOIN nm x USING (token_id) LEFT JOIN nm y ON y.token_id = before LEFT JOIN bi ON l = before AND r = z.token_id) GROUP BY phrase_id""",
    "ed": f"""SELECT z.*, {_pair_p('bi.c', 'y.uc', 'y.fo', 'x.cont')} AS lp, ln(x.cont + 1e-12) AS lc FROM (
            SELECT key, 0 AS kind, rank, te.score, [target_id] AS eids, [token] AS ewords, [noise] AS enoises, []::DOUBLE[] AS rest FROM te JOIN nm ON token_id = target_id WHERE rank <= 8
            UNION ALL SELECT key, 1, rank, pe.score, token_ids, words, noises, rest FROM pe JOIN ph ON phrase_id = target_id JOIN pw USING (phrase_id) WHERE rank <= 8) z
        JOIN nm x ON x.token_id = eids[1] JOIN nm y ON y.token_id = key[len(key)] LEFT JOIN bi ON l = key[len(key)] AND r = eids[1]""",
}


def serving(which: str, collapse: bool = True, words: int = 4, beam: int = 24, k: int = 10) -> dict[str, str]:
    """Table expressions up to ``top`` (prompt_id, rank, suggestion, score, ...): the default suggestions for the prompts of ``h`` that ``which`` names."""
    out = _EDGES | {
        "own": f"""SELECT h.prompt_id, hist, frag, coalesce(ids, []::INT[]) AS hids, coalesce(kn, 0.0)::DOUBLE AS kn0, coalesce(nz, 0.0)::DOUBLE AS nz0, z.token_id AS lid, uc AS luc, fo AS lfo, coalesce(ratio, 1.0)::DOUBLE AS ratio
            FROM h LEFT JOIN hi USING (prompt_id) LEFT JOIN hk USING (prompt_id) LEFT JOIN hr USING (prompt_id)
            LEFT JOIN (SELECT prompt_id, max({_noise('token')}) AS nz FROM ht GROUP BY prompt_id) USING (prompt_id) LEFT JOIN ht z ON z.prompt_id = h.prompt_id AND pos = len(hist) WHERE h.{which}""",
        "sf": "SELECT DISTINCT frag FROM own WHERE frag <> ''",
        "px": "SELECT DISTINCT prefix FROM post",
        "mt": f"""SELECT frag, frag AS matched, 0 AS dist FROM sf WHERE frag IN (SELECT prefix FROM px) UNION ALL
            SELECT frag, prefix, damerau_levenshtein(frag, prefix)::INT FROM sf, px WHERE frag NOT IN (SELECT prefix FROM px) AND abs(length(frag) - length(prefix)) <= {_EDITS} AND damerau_levenshtein(frag, prefix) <= {_EDITS}""",
        **backoff("own", "bk0", "prompt_id", "hids"),
        "se": """SELECT prompt_id, token_id, token, prior, matched, row_number() OVER (PARTITION BY prompt_id ORDER BY first) AS ord FROM (
            SELECT *, min((dist, matched, rank)) OVER (PARTITION BY prompt_id, token_id) AS first, row_number() OVER (PARTITION BY prompt_id, token_id ORDER BY prior DESC, dist, matched, rank) AS i
            FROM (SELECT own.prompt_id, post.token_id, post.token, post.rank, matched, dist, (post.score + coalesce(te.score, 0))::DOUBLE / 1024 - 0.75::DOUBLE * dist AS prior
                FROM own JOIN mt USING (frag) JOIN post ON post.prefix = matched LEFT JOIN bk0 ON bk0.prompt_id = own.prompt_id LEFT JOIN te ON te.key = bk0.key AND te.target_id = post.token_id)) WHERE i = 1""",
        "s0": f"""SELECT prompt_id, [token_id] AS ids, [se.token] AS words, prior, CASE WHEN len(hist) = 0 THEN ln((CASE WHEN x.uc > 0 THEN x.uc / tt.n ELSE 1 / (tt.n + tt.v) END) + 1e-12) ELSE {_pair_p('bi.c', 'luc', 'lfo', 'x.cont')} END AS kn,
                noise, matched, ord FROM se JOIN nm x USING (token_id) JOIN own USING (prompt_id) LEFT JOIN bi ON l = lid AND r = token_id, tt
            UNION ALL SELECT prompt_id, []::INT[], []::VARCHAR[], 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL, 1 FROM own WHERE frag = ''""",
    }
    for d in range(1, words + 1):
        out |= {
            f"u{d}": f"""SELECT * FROM (SELECT z.*, hids, lid, row_number() OVER (PARTITION BY prompt_id ORDER BY kn0 + kn + 0.35::DOUBLE * prior - 0.35::DOUBLE * greatest(nz0, noise) DESC, ord) AS place, list_concat(hids, ids) AS seen
                FROM s{d - 1} z JOIN own USING (prompt_id)) WHERE place <= {beam} AND len(ids) < {words}""",
            **backoff(f"u{d}", f"bk{d}", "prompt_id, place", "seen"),
            f"x{d}": f"""SELECT prompt_id, list_concat(ids, eids[1:t]) AS ids, list_concat(words, ewords[1:t]) AS words, prior + score::DOUBLE / 1024 AS prior,
                    kn + (CASE WHEN len(ids) > 0 OR lid IS NOT NULL THEN lp ELSE lc END) + coalesce(list_sum(rest[1:t - 1]), 0.0) AS kn, greatest(noise, list_max(enoises[1:t])) AS noise, matched,
                    place * 100000 + rank + CASE WHEN kind = 0 THEN 50000 ELSE 0 END AS ord, kind, {d} AS depth
                FROM (SELECT z.*, ed.*, least(len(eids), {words} - len(ids)) AS t FROM u{d} z JOIN bk{d} USING (prompt_id, place) JOIN ed USING (key))""",
            f"s{d}": f"SELECT prompt_id, ids, words, prior, kn, noise, matched, ord FROM x{d} WHERE kind = 0 AND len(ids) < {words}",
        }
    cols = "prompt_id, ids, words, prior, kn, noise, matched, ord"
    recent = "list_filter(list_transform(hist[greatest(1, len(hist) - 2):], lambda x: " + _form("x") + "), lambda x: x <> '')"
    out |= {
        "ev": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, ids ORDER BY prior DESC, depth, ord) AS i FROM (SELECT {cols}, 0 AS depth FROM s0 WHERE len(ids) > 0 UNION ALL "
        + " UNION ALL ".join(f"SELECT {cols}, depth FROM x{d}" for d in range(1, words + 1)) + ")) WHERE i = 1",
        "sg": f"SELECT ev.*, hist, kn0, nz0, ratio, {recent} AS rc, {_form('ev.words[1]')} AS f FROM ev JOIN own USING (prompt_id)",
        "sc": """SELECT *, array_to_string(list_concat(hist, words), ' ') AS suggestion, kn0 + kn AS scorer_score, 0.35::DOUBLE * greatest(nz0, noise) AS noise_penalty,
            kn0 + kn + 0.35::DOUBLE * prior - 0.35::DOUBLE * greatest(nz0, noise) - 0.25::DOUBLE * (1 - ratio) AS score FROM sg
            WHERE f <> '' AND NOT list_contains(rc, f) AND NOT (len(rc) >= 2 AND f = rc[len(rc) - 1] || rc[len(rc)]) AND NOT (len(rc) >= 3 AND f = rc[len(rc) - 2] || rc[len(rc) - 1] || rc[len(rc)])""",
    }
    if collapse:
        kind = "STRUCT(suggestion VARCHAR, score DOUBLE)[]"
        out["co"] = f"""SELECT prompt_id, unnest(list_reduce(list([{{'suggestion': suggestion, 'score': score}}] ORDER BY score DESC, suggestion), lambda a, x: CASE WHEN len(a) >= {k}
            OR len(list_filter(a, lambda y: starts_with(y.suggestion || ' ', x[1].suggestion || ' ') OR starts_with(x[1].suggestion || ' ', y.suggestion || ' '))) > 0 THEN a ELSE list_concat(a, x) END, []::{kind}), recursive := true) FROM sc GROUP BY prompt_id"""
    out["top"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, suggestion)::INT AS rank FROM {'co' if collapse else 'sc'}) WHERE rank <= {k}"
    return out


#: After ``top``: how many words the longest phrase at each place of a suggestion has, and the steps that follow from it.
TRACE: dict[str, str] = {
    "lw": """SELECT prompt_id, rank, i, max(CASE WHEN ph.phrase_id IS NULL THEN 1 ELSE wide END) AS wide FROM (
            SELECT prompt_id, rank, ids, i, unnest(range(1, len(ids) - i + 2)) AS wide FROM (SELECT prompt_id, rank, ids, unnest(range(1, len(ids) + 1)) AS i FROM top))
        LEFT JOIN ph ON wide > 1 AND ph.token_ids = ids[i:i + wide - 1] GROUP BY ALL""",
    "lv": "SELECT prompt_id, rank, list(wide ORDER BY i) AS wides FROM lw GROUP BY ALL",
    "st": """SELECT *, c3 + coalesce(wides[c3], 1) AS c4 FROM (SELECT *, c2 + coalesce(wides[c2], 1) AS c3 FROM (SELECT *, 1 AS c1, 1 + wides[1] AS c2 FROM top JOIN lv USING (prompt_id, rank)))""",
}


def steps() -> str:
    one = lambda c: f"CASE WHEN {c} <= len(ids) THEN CASE WHEN wides[{c}] > 1 THEN 'phrase:' ELSE 'token:' END || array_to_string(words[{c}:{c} + wides[{c}] - 1], ' ') END"
    return "array_to_string(list_filter([" + ", ".join(one(f"c{i}") for i in range(1, 5)) + "], lambda x: x IS NOT NULL), '|')"


def words_penalty(ws: str, n: str) -> str:
    """The reranker's penalty of a list of words that are ``n`` letters long with the spaces between them."""
    one = (
        r"CASE WHEN regexp_matches(w, '^[\p{L}\p{N}]+$') AND NOT regexp_matches(w, '^[0-9]+$') THEN (CASE WHEN length(w) = 1 AND lower(w) NOT IN ('a', 'i') THEN 4.0 ELSE 0.0 END)"
        r" + (CASE WHEN length(w) BETWEEN 5 AND 32 AND regexp_matches(w, '(?i)[a-z]{4,20}k$') THEN 1.2 ELSE 0.0 END)"
        r" + (CASE WHEN list_bool_or([w[i] = w[i + 1] AND w[i] = w[i + 2] FOR i IN range(1, length(w) - 1)]) THEN 0.5 ELSE 0.0 END) ELSE 0.0 END"
    )
    return f"(coalesce(list_sum(list_transform({ws}, lambda w: ({one})::DOUBLE)), 0.0) + 0.015::DOUBLE * {n} + 0.08::DOUBLE * len({ws}))"


#: After ``top``: suggestions with the prompt they continue, in the reranker's order.
RERANK: dict[str, str] = {
    "rp": r"""SELECT prompt_id, rank, suggestion, text AS prefix, rtrim(text) AS bare FROM top JOIN hp USING (prompt_id)""",
    "rt": r"""SELECT *, CASE WHEN prefix = '' THEN suggestion WHEN length(suggestion) >= length(prefix) AND starts_with(lower(suggestion), lower(prefix)) THEN ltrim(suggestion[length(prefix) + 1:])
        WHEN starts_with(lower(suggestion), lower(bare)) THEN ltrim(suggestion[length(bare) + 1:]) ELSE suggestion END AS tail FROM rp""",
    "rw": r"SELECT *, list_filter(string_split_regex(tail, '\s+'), lambda x: x <> '') AS ws FROM rt",
    "ro": f"SELECT prompt_id, suggestion AS text, row_number() OVER (PARTITION BY prompt_id ORDER BY CASE WHEN tail = '' THEN 0.0 ELSE {words_penalty('ws', 'length(tail)')} END, rank)::INT AS rank FROM rw",
}
