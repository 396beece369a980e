"""Alignment by longest common blocks as recursive SQL: one block a region and step."""

#: From ``seqs`` (key, a, b): ``blocks`` (key, i, j, n) and ``gaps`` (key, i1, i2, j1, j2, n), a gap before each block of n items and before the end.
BLOCKS = """ta as (select key, unnest(a) as t, unnest(range(len(a))) as p from seqs), tb as (select key, unnest(b) as t, unnest(range(len(b))) as p from seqs),
cells as (select ta.key, ta.p as i, tb.p as j, ta.p - row_number() over (partition by ta.key, ta.p - tb.p order by ta.p) as run from ta join tb on ta.key = tb.key and ta.t = tb.t),
runs as (select key, i, j, max(i) over (partition by key, i - j, run) - i + 1 as len from cells),
g(key, alo, ahi, blo, bhi, best) as (
  select s.key, 0, any_value(len(a)), 0, any_value(len(b)), max({'n': c.len, 'i': -c.i, 'j': -c.j}) from seqs s join runs c on c.key = s.key group by s.key
  union all
  select x.key, x.q.alo, x.q.ahi, x.q.blo, x.q.bhi, max({'n': least(c.len, x.q.ahi - c.i, x.q.bhi - c.j), 'i': -c.i, 'j': -c.j})
  from (select key, unnest([{'alo': alo, 'ahi': -best.i, 'blo': blo, 'bhi': -best.j}, {'alo': best.n - best.i, 'ahi': ahi, 'blo': best.n - best.j, 'bhi': bhi}]) as q from g) x
  join runs c on c.key = x.key and c.i >= x.q.alo and c.i < x.q.ahi and c.j >= x.q.blo and c.j < x.q.bhi group by x.key, x.q
),
blocks as (select key, -best.i as i, -best.j as j, best.n as n from g),
ends as (select key, i, j, n from blocks union all select key, len(a), len(b), 0 from seqs),
gaps as (select key, coalesce(lag(i + n) over w, 0) as i1, i as i2, coalesce(lag(j + n) over w, 0) as j1, j as j2, n from ends window w as (partition by key order by i, j, n))"""
