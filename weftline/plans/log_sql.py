"""SQL for the entries of logs: the same layouts as plain patterns, as an independent check of the grammar."""

from __future__ import annotations

_LV = "((?i:debug|dbg|info|inf|warn|warning|wrn|error|err|fatal|ftl|critical))"
_NAME = r"([A-Za-z_](?:[\w.-]*\w)?)"
_ISO = r"(\d{4}-\d\d-\d\d)"
_HMS = r"(\d\d:\d\d:\d\d)"

# Per layout: pattern; then expressions over its groups ``g1`` and up for date, clock, milliseconds, zone, level and component.
LAYOUTS = [
    (rf"^\[{_ISO}T{_HMS}([+-]\d\d:\d\d)\] (PHASE_[\w.]+) ([A-Z]+)(?: +[—–-].*)?$", "g1", "g2", "'0'", "g3", "g5", "g4"),
    (rf"^{_ISO} {_HMS},(\d\d\d)\d* +{_LV} +{_NAME}:", "g1", "g2", "g3", "''", "g4", "g5"),
    (rf"^(\d\d/[A-Z][a-z][a-z]/\d{{4}}):{_HMS} ([+-]\d{{4}}) \| {_NAME} \| {_LV} \|", "strftime(strptime(g1, '%d/%b/%Y'), '%Y-%m-%d')", "g2", "'0'", "g3", "g5", "g4"),
    (rf"^\[{_ISO} {_HMS}\.(\d\d\d)\d*\] \[{_LV}\] \[{_NAME}\]", "g1", "g2", "g3", "''", "g4", "g5"),
    (rf"^([DIWEFC])(\d\d\d\d) +{_HMS}\.(\d\d\d)\d* +\d+ {_NAME}:\d+\]", "y || '-' || substr(g2, 1, 2) || '-' || substr(g2, 3, 2)", "g3", "g4", "''", "g1", "g5"),
    (rf"^([A-Z][a-z][a-z] +\d+) {_HMS} \S+ {_NAME}\[\d+\]: {_LV}:", "strftime(strptime(y || ' ' || regexp_replace(g1, ' +', ' '), '%Y %b %d'), '%Y-%m-%d')", "g2", "'0'", "''", "g4", "g3"),
    (rf"^{_LV} +(\d{{4}}/\d\d/\d\d) {_HMS} {_NAME} - ", "replace(g2, '/', '-')", "g3", "'0'", "''", "g1", "g4"),
]


def _layout(i: int) -> str:
    rx, date, clock, ms, zone, level, comp = LAYOUTS[i]
    groups = ", ".join(f"regexp_extract(c, '{rx}', {k}) as g{k}" for k in range(1, 6))
    shift = f"case when {zone} = '' then 0 else (case when {zone}[1] = '-' then -1 else 1 end) * (cast(substr({zone}, 2, 2) as integer) * 60 + cast(right({zone}, 2) as integer)) * 60000 end"
    return (
        f"select log_name, line_no, epoch_ms(cast({date} || ' ' || {clock} as timestamp)) + cast({ms} as bigint) - {shift} as ts_ms, {level} as lv, {comp} as component "
        f"from (select log_name, line_no, y, {groups} from c where regexp_matches(c, '{rx}'))"
    )


_STAMP = r"epoch_ms(cast(replace(replace(left(t, 23), 'T', ' '), 'Z', '') as timestamp)) - case when regexp_matches(t, '[+-]\d\d:\d\d$') then (case when t[-6] = '-' then -1 else 1 end) * (cast(t[-5:-4] as integer) * 60 + cast(t[-2:] as integer)) * 60000 else 0 end"
_TIME = rf"case when regexp_matches(t, '^\d{{10}}([.]\d+)?$') then cast(left(t, 10) as bigint) * 1000 + cast(rpad(regexp_extract(t, '[.](\d+)', 1), 3, '0')[1:3] as bigint) else {_STAMP} end"

ENTRIES = (
    r"""with d as (select log_name, line_no, min(raw) as raw, min(captured_at) as seen from log_lines where log_name is not null and line_no is not null group by 1, 2),
c as (select log_name, line_no, cast(year(seen) as varchar) as y, regexp_replace(rtrim(raw, chr(13)), chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g') as c from d),
k as (select log_name, line_no, coalesce(nullif(regexp_extract(c, '^(?:ts|time)=(\S+)', 1), ''), regexp_extract(c, ' (?:ts|time)=(\S+)', 1)) as t, regexp_extract(c, '\blevel=(\w+)', 1) as lv, regexp_extract(c, '\bcomponent=(\S+)', 1) as component
  from c where regexp_matches(c, '^(ts|time)=\S+ ') and regexp_matches(c, ' level=\w+') and regexp_matches(c, ' component=\S+')),
o as (select a.log_name, a.line_no, (select min(b.line_no) from c b where b.log_name = a.log_name and b.line_no > a.line_no and b.c = '}') as stop from c a where a.c = '{'),
w as (select o.log_name, o.line_no, string_agg(c.c, ' ' order by c.line_no) as body from o join c on c.log_name = o.log_name and c.line_no between o.line_no and o.stop group by 1, 2),
j as (select log_name, line_no, try_cast(body as json) as j from w union all select log_name, line_no, try_cast(c as json) from c where c like '{"%'),
js as (select log_name, line_no, coalesce(j ->> 'ts', j ->> 'time') as t, j ->> 'level' as lv, coalesce(j ->> 'component', j ->> 'logger') as component from j where j is not null and coalesce(j ->> 'ts', j ->> 'time') is not null and j ->> 'level' is not null),
e as ("""
    + " union all ".join(_layout(i) for i in range(len(LAYOUTS)))
    + rf""" union all select log_name, line_no, cast(regexp_extract(c, '^(\d{{13}}) ', 1) as bigint), regexp_extract(c, '^\d{{13}} {_LV} \(', 1), regexp_extract(c, '^\d{{13}} {_LV} \({_NAME}\)', 2) from c where regexp_matches(c, '^\d{{13}} {_LV} \({_NAME}\)')
  union all select log_name, line_no, {_TIME}, lv, component from k union all select log_name, line_no, {_TIME}, lv, component from js),
n as (select log_name, line_no, ts_ms, component, case lower(lv) when 'd' then 'DEBUG' when 'i' then 'INFO' when 'w' then 'WARN' when 'e' then 'ERROR' when 'f' then 'FATAL' when 'c' then 'FATAL' when 'debug' then 'DEBUG' when 'dbg' then 'DEBUG'
  when 'info' then 'INFO' when 'inf' then 'INFO' when 'warn' then 'WARN' when 'warning' then 'WARN' when 'wrn' then 'WARN' when 'error' then 'ERROR' when 'err' then 'ERROR' when 'fatal' then 'FATAL' when 'ftl' then 'FATAL' when 'critical' then 'FATAL' else lv end as level from e),
m as (select log_name, max(line_no) as stop from d group by 1),
entries as (select n.log_name, n.line_no, coalesce(lead(n.line_no) over (partition by n.log_name order by n.line_no) - 1, m.stop) as last_line, n.ts_ms, n.level, n.component from n join m using (log_name))"""
)

_PAYLOAD = rf"""select e.log_name, e.line_no, trim(regexp_extract(c.c, '{LAYOUTS[0][0].split("(?:")[0]} +[—–-]+(.*)$', 6)) as body from entries e join c using (log_name, line_no) where e.component like 'PHASE_%'"""
SQL = {
    "p4_found": ENTRIES + " select * from entries",
    "p4_phases": ENTRIES + " select log_name, line_no, ts_ms, substr(component, 7) as phase_id, level as status from entries where component like 'PHASE_%'",
    "p4_payload": ENTRIES
    + f""", bodies as ({_PAYLOAD}), parts as (select log_name, line_no, unnest(regexp_split_to_array(body, '\\s+')) as w, generate_subscripts(regexp_split_to_array(body, '\\s+'), 1) as i from bodies)
    select log_name, line_no, regexp_extract(w, '^([^=]*)=', 1) as field, arg_max(regexp_extract(w, '^[^=]*=(.*)$', 1), i) as value from parts where contains(w, '=') group by 1, 2, 3""",
}
