"""The template miner as DuckDB SQL: signatures become leaders one after another."""

from __future__ import annotations

SAME = "len(list_filter(list_zip(a.tokens, b.tokens), lambda z: z[1] = z[2] and z[1] <> '<*>'))"


def mined(ev: str, out: str, seed: str | None = None, sim_th: float = 0.4) -> dict[str, str]:
    """CTEs (in a ``with recursive``) that mine the signed events of ``ev`` into
    ``out`` (template_id, template, tokens, size, first_line), on top of the
    templates of ``seed``; a leaf is the token count and the first token."""
    p = f"{out}_"
    stored = f"union all select template_id, tokens, size, -1 from {seed}" if seed else ""
    m = f"(select count(*) from {seed})" if seed else "0"
    last = f"(select max(template_id) from {seed})" if seed else "0"
    seen = f"(select s.first_line from {seed} s where s.template_id = seed_id)" if seed else "f.first_line"
    least = f"greatest(1, ceil(w * {sim_th} - 1e-9))"
    return {
        f"{p}text": rf"select line_id, template, string_split_regex(trim(content), '\s+') as c from {ev}",
        f"{p}pos": f"""select template, pos, case when count(distinct c[pos]) = 1 then min(c[pos]) else string_split(template, ' ')[pos] end as t
            from (select *, unnest(generate_series(1, len(c))) as pos from {p}text) x group by template, pos""",
        f"{p}sig": f"""select -1 as seed_id, tokens, size, first_line from (select template, list(t order by pos) as tokens from {p}pos group by template) a
            join (select template, count(*) as size, min(line_id) as first_line from {p}text group by template) b using (template) {stored}""",
        f"{p}rows": f"""select row_number() over (order by seed_id < 0, seed_id, first_line, array_to_string(tokens, ' ')) as rk, *,
            concat(len(tokens), ' ', case when len(tokens) = 1 then '' when regexp_matches(tokens[1], '[0-9]') or tokens[1] = '<*>' then '<*>' else tokens[1] end) as leaf
            from {p}sig""",
        f"{p}near": f"""select * from (select b.rk, a.rk as head, {SAME} as same, len(a.tokens) as w from {p}rows a join {p}rows b on a.leaf = b.leaf and a.rk < b.rk) x
            where same >= {least} and rk > {m}""",
        f"{p}before": f"select rk, list(head) as heads from {p}near group by rk",
        f"{p}step(i, leaders)": f"""select cast({m} as bigint), generate_series(1, {m}) union all
            select i + 1, case when list_has_any(leaders, coalesce((select heads from {p}before where rk = i + 1), [])) then leaders else list_append(leaders, i + 1) end
            from {p}step where i < (select count(*) from {p}rows)""",
        f"{p}heads": f"select unnest(leaders) as head from {p}step where i = (select count(*) from {p}rows)",
        f"{p}owner": f"""select head as rk, head as owner from {p}heads union all
            select rk, min_by(head, head - same * 1000000) from {p}near where rk not in (from {p}heads) and head in (from {p}heads) group by rk""",
        f"{p}common": f"""select owner, list(t order by pos) as tokens from (select owner, pos, case when count(distinct t) = 1 then min(t) else '<*>' end as t
            from (select owner, unnest(generate_series(1, len(tokens))) as pos, unnest(tokens) as t from {p}rows join {p}owner using (rk)) y group by owner, pos) x group by owner""",
        f"{p}found": f"""select c.tokens, sum(size) as size, min(first_line) as first_line, max(seed_id) as seed_id
            from {p}rows r join {p}owner using (rk) join {p}common c using (owner) group by owner, c.tokens""",
        f"{p}text_of": f"""select tokens, coalesce(sum(size) filter (where seed_id < 0), 0) as n, min(first_line) as first_line,
            min(seed_id) filter (where seed_id >= 0) as keep from {p}found group by tokens""",
        out: f"""
            select {last} + row_number() over (order by first_line, array_to_string(tokens, ' ')) as template_id, array_to_string(tokens, ' ') as template, tokens,
              cast(n as bigint) as size, first_line from {p}text_of where keep is null
            union all
            select seed_id, array_to_string(f.tokens, ' '), f.tokens, cast(f.size + case when seed_id = keep then n else 0 end as bigint), {seen}
            from {p}found f join {p}text_of using (tokens) where seed_id >= 0""",
    }
