"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

from types import SimpleNamespace as Values

# The parameters and names are written out here once more, so that a wrong one in the package shows.

FIRST, LAST = "DATE '1995-01-01'", "DATE '2001-07-01'"
CURRENT, PRIOR = "DATE '2001-04-01'", "DATE '2000-04-01'"
Y1, Y2 = 1999, 2000
#: Quarters and the names of their columns.
QUARTERS = [
    (f"{year}-{3 * k + 1:02d}-01", f"{name}_{year % 100:02d}")
    for year in range(1995, 2002)
    for k, name in enumerate(("mar", "jun", "set", "dez"))
][:27]


def _category(key, column, label, ordem, codigo=None):
    return Values(key=key, column=column, label=label, ordem=ordem, codigo=codigo)


MODALITIES = (
    _category("AUTOMOBILE", "automobile", "Automobile", 1),
    _category("BUILDING", "building", "Building", 2),
    _category("FURNITURE", "furniture", "Furniture", 3),
    _category("HOUSEHOLD", "household", "Household", 4),
    _category("MACHINERY", "machinery", "Machinery", 5),
)


def _regions(america, europe):
    return (
        _category("AFRICA", "africa", "Africa", 1, 1),
        _category("AMERICA", "america", "America", america, 2),
        _category("ASIA", "asia", "Asia", 5, 3),
        _category("EUROPE", "europe", "Europe", europe, 4),
        _category("MIDDLE EAST", "middle_east", "Middle East", 2, 5),
    )


#: Accounts of the 16 classes of ledger rows.
_SHARED = {
    8: "outras_receitas_operacionais",
    13: "despesa_administrativa",
    14: "despesa_de_comercializacao",
    15: "outras_despesas_operacionais",
}
CLASSES_MED = {
    **{k: "receita_de_contraprestacoes_medica" for k in range(7)},
    7: "contraprestacoes_de_corresponsabilidade_transferida_medica",
    9: "outras_deducoes_medica",
    **{k: "despesa_assistencial_medica" for k in (10, 11, 12)},
    **_SHARED,
}
CLASSES_ODO = {
    **{k: "receita_de_contraprestacoes_odonto" for k in range(7)},
    7: "contraprestacoes_de_corresponsabilidade_transferida_odonto",
    9: "outras_deducoes_odonto",
    **{k: "despesa_assistencial_odonto" for k in (10, 11, 12)},
    **_SHARED,
}
STAR_MED = Values(
    segmento="MED",
    regions=_regions(3, 4),
    modalities=MODALITIES,
    classes=CLASSES_MED,
    accounts=(
        "receita_de_contraprestacoes_medica",
        "outras_receitas_operacionais",
        "contraprestacoes_de_corresponsabilidade_transferida_medica",
        "outras_deducoes_medica",
        "despesa_assistencial_medica",
        "despesa_administrativa",
        "despesa_de_comercializacao",
        "outras_despesas_operacionais",
    ),
    missing_account_is_zero=True,
    income_label="Receitas de Contraprestações",
    expense_label="Despesa Assistencial",
    result_label="Resultado Operacional",
)
STAR_ODO = Values(
    segmento="ODO",
    regions=_regions(4, 3),
    modalities=MODALITIES,
    classes=CLASSES_ODO,
    accounts=(
        "receita_de_contraprestacoes_odonto",
        "contraprestacoes_de_corresponsabilidade_transferida_odonto",
        "outras_deducoes_odonto",
        "despesa_assistencial_odonto",
    ),
    missing_account_is_zero=False,
    income_label="Receitas de Contraprestações Odonto",
    expense_label="Despesa Assistencial Odonto",
    result_label="Resultado Operacional",
)
MODS = [(c.key, c.column) for c in MODALITIES]
REGS = [(c.key, c.column) for c in STAR_MED.regions]
REGS_ALL = [*REGS, ("nao_identificado", "nao_identificado")]

FACT = f"""
raw_fact AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'MED' ELSE 'ODO' END AS segmento,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS competencia,
         CAST(o_custkey AS VARCHAR) AS registro,
         c_name AS operadora,
         c_mktsegment AS modalidade,
         COALESCE(r_name, 'nao_identificado') AS regiao,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
),
fact AS (
  SELECT segmento, competencia, registro, operadora, modalidade, regiao,
         CAST(SUM(q) AS BIGINT) AS beneficiarios
  FROM raw_fact
  WHERE competencia BETWEEN {FIRST} AND {LAST}
  GROUP BY ALL
)"""

MEMBERS = """
raw_members AS (
  SELECT 'MED' AS segmento, CAST(c_custkey AS VARCHAR) AS registro, c_name AS razao_social
  FROM customer WHERE c_acctbal >= 7300
  UNION ALL
  SELECT 'ODO', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_acctbal < 1750
),
members AS (SELECT DISTINCT segmento, registro, 1 AS m FROM raw_members)"""


def cases(expr: str, values, cast: str = "") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values) + " END"


def _account_case(spec) -> str:
    return cases("k", sorted(spec.classes.items()))


_NEGATIVE = "7, 9"

LEDGER = f"""
raw_ledger AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'MED' ELSE 'ODO' END AS segmento,
         CAST(l_suppkey AS VARCHAR) AS registro,
         {cases("l_suppkey % 5", [(i, k) for i, (k, _) in enumerate(MODS)])} AS modalidade,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ano_tri,
         (l_orderkey + l_linenumber) % 16 AS k,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
ledger AS (
  SELECT segmento, registro, modalidade, ano_tri,
         CASE WHEN segmento = 'MED' THEN {_account_case(STAR_MED)}
              ELSE {_account_case(STAR_ODO)} END AS class_conta,
         CASE WHEN k IN ({_NEGATIVE}) THEN -v ELSE v END AS saldo
  FROM raw_ledger
)"""


def pivoted(spec) -> str:
    zero = spec.missing_account_is_zero
    cols = []
    for a in spec.accounts:
        s = f"CAST(SUM(CASE WHEN class_conta = '{a}' THEN saldo END) AS BIGINT)"
        cols.append(f"{f'COALESCE({s}, 0)' if zero else s} AS {a}")
    return f"""SELECT segmento, registro, modalidade, ano_tri, {", ".join(cols)}
  FROM ledger WHERE segmento = '{spec.segmento}' GROUP BY 1, 2, 3, 4"""


MED_RESULT = """receita_de_contraprestacoes_medica + outras_receitas_operacionais
  + contraprestacoes_de_corresponsabilidade_transferida_medica + outras_deducoes_medica
  - despesa_assistencial_medica - despesa_administrativa - despesa_de_comercializacao
  - outras_despesas_operacionais"""
ODO_RESULT = """receita_de_contraprestacoes_odonto
  + contraprestacoes_de_corresponsabilidade_transferida_odonto + outras_deducoes_odonto
  - despesa_assistencial_odonto"""

RESULT = f"""{LEDGER},
med_wide AS ({pivoted(STAR_MED)}),
odo_wide AS ({pivoted(STAR_ODO)}),
positions AS (
  SELECT segmento, registro, modalidade, CAST(year(ano_tri) AS INT) AS ano,
         receita_de_contraprestacoes_medica AS receita,
         contraprestacoes_de_corresponsabilidade_transferida_medica AS corresp,
         despesa_assistencial_medica AS despesa, {MED_RESULT} AS res_op
  FROM med_wide
  UNION ALL
  SELECT segmento, registro, modalidade, CAST(year(ano_tri) AS INT),
         receita_de_contraprestacoes_odonto,
         contraprestacoes_de_corresponsabilidade_transferida_odonto,
         despesa_assistencial_odonto, {ODO_RESULT}
  FROM odo_wide
)"""


def rnd(x: str, k: int) -> str:
    return f"(floor(({x}) * 1e{k} + 5e-1) / 1e{k})"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return rnd(f"100 * ({ratio(a, b)} - 1)", 1)


def num(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(18,1)) AS VARCHAR), '\\.0$', '')"


def bsum(x: str = "beneficiarios") -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def at(quarter: str, extra: str = "") -> str:
    return bsum(f"CASE WHEN competencia = {quarter}{extra} THEN beneficiarios END")


def money(income: str, k: int, fr: str) -> str:
    return f"""SELECT segmento, ano,
    {rnd(f"CAST({income} AS DOUBLE) / 1e8", k)} AS receita_de_contraprestacoes,
    {rnd("CAST(COALESCE(SUM(despesa), 0) AS DOUBLE) / 1e8", k)} AS despesa_assistencial,
    {rnd("CAST(COALESCE(SUM(res_op), 0) AS DOUBLE) / 1e8", k)} AS resultado_operacional
  FROM {fr} GROUP BY segmento, ano"""


NET = "(COALESCE(SUM(receita), 0) + COALESCE(SUM(corresp), 0))"
GROSS = "COALESCE(SUM(receita), 0)"

YEARS = f"{RESULT},\nyears AS ({money(NET, 1, 'positions')})"
OWN = f"""{RESULT}, {MEMBERS},
own_rows AS (SELECT positions.* FROM positions JOIN members USING (segmento, registro)
             WHERE ano IN ({Y1}, {Y2})),
own AS ({money(GROSS, 2, 'own_rows')})"""


def metric_rows(table: str, where: str = "TRUE") -> str:
    """Metrics to rows, the two years to columns."""
    parts = []
    for s in (STAR_MED, STAR_ODO):
        labels = (s.income_label, s.expense_label, s.result_label)
        names = ("receita_de_contraprestacoes", "despesa_assistencial", "resultado_operacional")
        for i, (n, t) in enumerate(zip(names, labels), 1):
            parts.append(
                f"SELECT segmento, CAST({i} AS INT) AS ordem, '{t}' AS tipo, "
                f"MAX(CASE WHEN ano = {Y1} THEN {n} END) AS ano_ant, "
                f"MAX(CASE WHEN ano = {Y2} THEN {n} END) AS ano_atu "
                f"FROM {table} WHERE segmento = '{s.segmento}' AND {where} GROUP BY segmento"
            )
    return "\nUNION ALL\n".join(parts)


PANEL = f"""{FACT}, {MEMBERS},
anchor AS (SELECT DISTINCT segmento, registro, operadora FROM fact
           WHERE year(competencia) = 1995),
spine AS (SELECT DISTINCT CAST(d AS DATE) AS competencia
          FROM range({FIRST}, DATE '2001-07-02', INTERVAL 3 MONTH) t(d)),
panel AS (
  SELECT a.segmento, a.registro, a.operadora, CAST(COALESCE(m.m, 0) AS INT) AS associada,
         s.competencia, COALESCE(SUM(f.beneficiarios), 0) AS beneficiarios
  FROM anchor a CROSS JOIN spine s
  LEFT JOIN fact f ON f.segmento = a.segmento AND f.registro = a.registro
    AND f.operadora = a.operadora AND f.competencia = s.competencia
  LEFT JOIN members m ON m.segmento = a.segmento AND m.registro = a.registro
  GROUP BY 1, 2, 3, 4, 5
),
series AS (
  SELECT segmento, competencia, {bsum()} AS mercado,
         {bsum("CASE WHEN associada = 1 THEN beneficiarios END")} AS associadas
  FROM panel GROUP BY 1, 2
),
yoy AS (
  SELECT segmento, competencia, mercado, associadas,
         {ratio("associadas", "lag(associadas, 4) OVER w")} - 1 AS var_tri_assoc,
         {ratio("mercado", "lag(mercado, 4) OVER w")} - 1 AS var_tri_mercado
  FROM series WINDOW w AS (PARTITION BY segmento ORDER BY competencia)
)"""


def wide(columns, coluna: str) -> str:
    cells = [
        f"{bsum(f'CASE WHEN {coluna} = {v!r} THEN beneficiarios END')} AS {name}"
        for v, name in columns
    ]
    return ", ".join([*cells, f"{bsum()} AS total"])


FLAGGED = "LEFT JOIN members USING (segmento, registro)"
FLAG = "CAST(COALESCE(m, 0) AS INT) AS associada"


def share(segmento: str, headline: str | None) -> str:
    value = (
        f"CASE WHEN modalidade = '{headline}' THEN beneficiarios END" if headline else "beneficiarios"
    )
    return f"""
by_op AS (SELECT segmento, registro, COALESCE(SUM({value}), 0) AS v FROM fact
          WHERE competencia = {CURRENT} AND segmento = '{segmento}' GROUP BY 1, 2),
groups AS (SELECT segmento, {FLAG}, {bsum("v")} AS beneficiarios FROM by_op {FLAGGED}
           GROUP BY 1, 2),
shares AS (SELECT segmento, associada, beneficiarios,
             {ratio("beneficiarios", "SUM(beneficiarios) OVER (PARTITION BY segmento)")}
               AS percentual FROM groups)"""


def region_dim() -> str:
    rows = ", ".join(
        f"('{s.segmento}', '{c.key}', '{c.column}', '{c.label}', {c.ordem}, {c.codigo})"
        for s in (STAR_MED, STAR_ODO)
        for c in s.regions
    )
    return f"dim(segmento, regiao, coluna, nome, ordem, codigo) AS (VALUES {rows})"


REGION_SNAPSHOT = f"""{FACT}, {MEMBERS}, {region_dim()},
by_region AS (
  SELECT segmento, regiao, {bsum()} AS benef,
         {bsum("CASE WHEN m = 1 THEN beneficiarios END")} AS benef_associadas
  FROM fact {FLAGGED} WHERE competencia = {CURRENT} GROUP BY 1, 2
),
snap AS (SELECT dim.*, benef, benef_associadas FROM dim
         LEFT JOIN by_region USING (segmento, regiao))"""

INDIVIDUAL = f"""{FACT}, {MEMBERS},
lives AS (
  SELECT registro,
    MAX(CASE WHEN segmento = 'MED' AND competencia = {CURRENT} THEN operadora END) AS operadora,
    {at(CURRENT, " AND segmento = 'MED'")} AS a,
    {at(PRIOR, " AND segmento = 'MED'")} AS b,
    {at(CURRENT, " AND segmento = 'ODO'")} AS c,
    {at(PRIOR, " AND segmento = 'ODO'")} AS d
  FROM fact GROUP BY registro
),
individual AS (
  SELECT registro, operadora, a AS beneficiarios_medicos,
    {num(f"COALESCE({pct('a', 'b')}, 0)")} || '%' AS variacao_anual_medico,
    COALESCE(c, 0) AS beneficiarios_odonto,
    COALESCE({num(pct('c', 'd'))} || '%', '-') AS variacao_anual_odonto
  FROM lives
  WHERE a IS NOT NULL
    AND registro IN (SELECT registro FROM members WHERE segmento = 'MED')
)"""

SNAPSHOT = f"""{FACT},
snap AS (
  SELECT segmento, {at(PRIOR)} AS a, {at(CURRENT)} AS b,
    {bsum(f'''CASE WHEN competencia = {CURRENT}
      AND modalidade = CASE segmento WHEN 'MED' THEN 'BUILDING' ELSE 'HOUSEHOLD' END
      THEN beneficiarios END''')} AS h
  FROM fact GROUP BY segmento
)"""

TOTALTRI = pct("b", "a")
MODTRI = f"100 * {rnd(ratio('h', 'b'), 3)}"


def cell(name: str, year: int) -> str:
    return f"MAX(CASE WHEN ano = {year} THEN {name} END)"


INCOME, EXPENSE, OUTCOME = (
    "receita_de_contraprestacoes",
    "despesa_assistencial",
    "resultado_operacional",
)


def growth(name: str) -> str:
    return pct(cell(name, Y2), cell(name, Y1))


def compare_rows(keys: str, columns, coluna: str) -> str:
    """Dimension rows with the rounded lives of both quarters."""

    def lives(q: str, when: str) -> str:
        return rnd(f"CAST({at(q, when)} AS DOUBLE) / 1e3", 1)

    parts = []
    for s in (STAR_MED, STAR_ODO):
        for c in columns(s):
            when = "" if c[0] is None else f" AND {coluna} = '{c[0]}'"
            parts.append(
                f"SELECT segmento, CAST({c[2]} AS INT) AS ordem, '{c[1]}' AS {keys}, "
                f"{lives(PRIOR, when)} AS ant, {lives(CURRENT, when)} AS atu "
                f"FROM fact WHERE segmento = '{s.segmento}' GROUP BY segmento"
            )
    return "\nUNION ALL\n".join(parts)


def kpi(table: str, name: str, expr: str, suffix: str, shown: str | None = None) -> str:
    return (
        f"SELECT segmento, '{name}' AS kpi, CAST({expr} AS DOUBLE) AS valor, "
        f"{num(shown or expr)} || '{suffix}' AS texto FROM {table}"
    )


def _kpi_table() -> str:
    ctes = f"""{PANEL}, {LEDGER.strip()}, {RESULT.split(LEDGER, 1)[1].lstrip(',')},
years AS ({money(NET, 1, 'positions')}),
own_rows AS (SELECT positions.* FROM positions JOIN members USING (segmento, registro)
             WHERE ano IN ({Y1}, {Y2})),
own AS ({money(GROSS, 2, 'own_rows')}),
{SNAPSHOT.split(FACT, 1)[1].lstrip(',')},
{INDIVIDUAL.split(MEMBERS, 1)[1].lstrip(',')},
fin AS (SELECT segmento, {cell(INCOME, Y2)} AS fat, {growth(INCOME)} AS fat_g,
          {cell(EXPENSE, Y2)} AS desp, {growth(EXPENSE)} AS desp_g FROM years GROUP BY 1),
var AS (SELECT segmento, {growth(INCOME)} AS v1, {growth(EXPENSE)} AS v2,
          {growth(OUTCOME)} AS v3 FROM own GROUP BY 1),
cnt AS (SELECT segmento, COUNT(*) AS n FROM raw_members GROUP BY 1),
now AS (SELECT * FROM yoy WHERE competencia = {CURRENT}),
ind AS (SELECT 'MED' AS segmento, SUM(beneficiarios_medicos) + SUM(beneficiarios_odonto) AS n
        FROM individual)"""
    cover = ratio("associadas", "mercado")
    rows = [
        kpi("snap", "totaltri", TOTALTRI, "%"),
        kpi("snap", "modalidade_tri", MODTRI, "%"),
        kpi("fin", "fat_total", "fat", " bi"),
        kpi("fin", "fat_total_cres", "fat_g", "%"),
        kpi("fin", "desp_total", "desp", " bi"),
        kpi("fin", "desp_total_cres", "desp_g", "%"),
        kpi("cnt", "n_associadas", "n", ""),
        kpi("ind", "total_benef", rnd("CAST(n AS DOUBLE) / 1e3", 1), " milhões"),
        kpi("now", "total_benef", rnd("CAST(associadas AS DOUBLE) / 1e3", 1), " milhões")
        + " WHERE segmento = 'ODO'",
        kpi("now", "var_a", rnd("var_tri_assoc * 100", 1), "%"),
        kpi("now", "perc_a", cover, "%", rnd(f"100 * {cover}", 1)) + " WHERE segmento = 'MED'",
        kpi("var", "fat_var_1", "v1", "%"),
        kpi("var", "fat_var_2", "v2", "%"),
        kpi("var", "fat_var_3", "v3", "%"),
    ]
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(rows)


MONTHS = {1: "Mar", 2: "Jun", 3: "Set", 4: "Dez"}

ORACLE: dict[str, str] = {
    "q01_crosstab_to_fact": f"""WITH {FACT}
SELECT segmento, competencia, regiao, {bsum()} AS beneficiarios FROM fact GROUP BY 1, 2, 3""",
    "q02_crosstab_margins": f"""WITH {FACT}
SELECT segmento,
  CASE WHEN GROUPING(competencia) = 1 THEN 'TOTAL' ELSE CAST(competencia AS VARCHAR) END
    AS competencia,
  CASE WHEN GROUPING(modalidade) = 1 THEN 'total' ELSE modalidade END AS modalidade,
  {bsum()} AS beneficiarios
FROM fact GROUP BY GROUPING SETS ((segmento, competencia, modalidade), (segmento, competencia),
  (segmento, modalidade), (segmento))""",
    "q02a_period_by_modality": f"""WITH {FACT}
SELECT segmento, competencia AS trimestre, {wide(MODS, "modalidade")} FROM fact
GROUP BY 1, 2""",
    "q02b_period_by_region": f"""WITH {FACT}
SELECT segmento, competencia AS trimestre, {wide(REGS_ALL, "regiao")} FROM fact
GROUP BY 1, 2""",
    "q02c_operator_by_period": f"""WITH {FACT}
SELECT segmento, registro, operadora,
  {wide(QUARTERS, "CAST(competencia AS VARCHAR)")}
FROM fact GROUP BY 1, 2, 3""",
    "q02d_operator_by_modality": f"""WITH {FACT}, {MEMBERS},
t AS (SELECT segmento, competencia, registro, operadora, {wide(MODS, "modalidade")} FROM fact
      WHERE competencia IN ({CURRENT}, {PRIOR}) GROUP BY 1, 2, 3, 4)
SELECT t.*, {FLAG} FROM t {FLAGGED}""",
    "q02e_operator_total": f"""WITH {FACT}, {MEMBERS},
t AS (SELECT segmento, competencia, registro, {bsum()} AS total FROM fact
      WHERE competencia IN ({CURRENT}, {PRIOR}) GROUP BY 1, 2, 3)
SELECT t.*, {FLAG} FROM t {FLAGGED}""",
    "q02f_operator_by_region": f"""WITH {FACT}, {MEMBERS},
t AS (SELECT segmento, registro, operadora, {wide(REGS_ALL, "regiao")} FROM fact
      WHERE competencia = {CURRENT} GROUP BY 1, 2, 3)
SELECT t.*, {FLAG} FROM t {FLAGGED}""",
    "q03_members": f"""WITH {MEMBERS}
SELECT segmento, registro, CAST(1 AS INT) AS associada, razao_social FROM raw_members""",
    "q04_ledger_wide": f"WITH {LEDGER}\n{pivoted(STAR_MED)}",
    "q05_member_flag": f"""WITH {FACT}, {MEMBERS},
t AS (SELECT DISTINCT segmento, competencia, registro FROM fact
      WHERE competencia IN ({CURRENT}, {PRIOR}))
SELECT t.*, {FLAG} FROM t {FLAGGED}""",
    "q06_anchor_panel": f"""WITH {PANEL}
SELECT segmento, registro, operadora, associada, competencia,
  CAST(beneficiarios AS BIGINT) AS beneficiarios FROM panel""",
    "q07_market_total": f"""WITH {PANEL}
SELECT segmento, competencia AS trimestre, mercado AS beneficiarios FROM series""",
    "q08_member_total": f"""WITH {PANEL}
SELECT segmento, competencia AS trimestre, associadas AS beneficiarios FROM series
WHERE associadas IS NOT NULL""",
    "q09_market_yoy": f"""WITH {PANEL}
SELECT segmento, competencia AS trimestre, mercado, associadas, var_tri_assoc, var_tri_mercado
FROM yoy WHERE year(competencia) > 1996""",
    "q10_share_modality": f"""WITH {FACT}, {MEMBERS}, {share("MED", "BUILDING")}
SELECT * FROM shares""",
    "q10o_share_modality": f"""WITH {FACT}, {MEMBERS}, {share("ODO", "HOUSEHOLD")}
SELECT * FROM shares""",
    "q11_share_total": f"""WITH {FACT}, {MEMBERS}, {share("ODO", None)}
SELECT * FROM shares""",
    "q12_result_med": f"""WITH {LEDGER}, w AS ({pivoted(STAR_MED)})
SELECT w.*, CAST(year(ano_tri) AS INT) AS ano, {MED_RESULT} AS res_op FROM w""",
    "q13_result_odo": f"""WITH {LEDGER}, w AS ({pivoted(STAR_ODO)})
SELECT w.*, CAST(year(ano_tri) AS INT) AS ano, {ODO_RESULT} AS res_op FROM w""",
    "q14_finance_year": f"WITH {YEARS}\nSELECT * FROM years",
    "q15_finance_compare": f"WITH {YEARS}\nSELECT * FROM years WHERE ano IN ({Y1}, {Y2})",
    "q16_finance_members": f"WITH {OWN}\nSELECT * FROM own",
    "q17_finance_modality": f"""WITH {RESULT},
sel AS (SELECT * FROM positions WHERE segmento = 'MED' AND modalidade = 'BUILDING'),
t AS ({money(NET, 1, "sel")}), r AS ({metric_rows("t")})
SELECT segmento, ordem, tipo, ano_ant, ano_atu FROM r WHERE segmento = 'MED'""",
    "q18_finance_total": f"""WITH {YEARS}, r AS ({metric_rows("years")})
SELECT segmento, ordem, tipo, ano_ant, ano_atu FROM r WHERE segmento = 'ODO'""",
    "q19_member_region": f"""WITH {REGION_SNAPSHOT}
SELECT segmento, regiao, benef_associadas FROM snap""",
    "q20_region_share": f"""WITH {REGION_SNAPSHOT}
SELECT segmento, CAST(codigo AS INT) AS code_region, nome AS regiao, benef, benef_associadas,
  {ratio("benef_associadas", "benef")} AS taxa,
  {num(rnd(f"{ratio('benef_associadas', 'benef')} * 100", 1))} || '%' AS rotulo
FROM snap""",
    "q21_total_growth": f"WITH {SNAPSHOT}\nSELECT segmento, {TOTALTRI} AS totaltri FROM snap",
    "q22_modality_pct": f"WITH {SNAPSHOT}\nSELECT segmento, {MODTRI} AS modalidade_tri FROM snap",
    "q23_finance_cells": f"""WITH {YEARS}
SELECT segmento, {INCOME} AS fat_total, {EXPENSE} AS desp_total FROM years WHERE ano = {Y2}""",
    "q24_region_compare": f"WITH {FACT}\n"
    + compare_rows(
        "regioes", lambda s: [(c.key, c.label, c.ordem) for c in s.regions], "regiao"
    ),
    "q25_region_yoy": f"""WITH {FACT},
t AS (SELECT segmento, competencia, {wide(REGS, "regiao")} FROM fact GROUP BY 1, 2),
y AS (SELECT segmento, competencia,
  {", ".join(f"{ratio(n, f'lag({n}, 4) OVER w')} - 1 AS {n}" for _, n in REGS)}
  FROM t WINDOW w AS (PARTITION BY segmento ORDER BY competencia))
SELECT segmento, CAST(competencia + INTERVAL 2 MONTH AS DATE) AS trimestre,
  {", ".join(n for _, n in REGS)}
FROM y WHERE year(competencia) <> 1995""",
    "q26_modality_compare": f"WITH {FACT}\n"
    + compare_rows(
        "modalidade",
        lambda s: [*[(c.key, c.label, c.ordem) for c in s.modalities], (None, "Total", 6)],
        "modalidade",
    ),
    "q27_individual": f"WITH {INDIVIDUAL}\nSELECT * FROM individual",
    "q28_individual_total": f"""WITH {INDIVIDUAL}
SELECT * FROM individual
UNION ALL
SELECT 'TOTAL', '', CAST(COALESCE(SUM(beneficiarios_medicos), 0) AS BIGINT), '',
  CAST(COALESCE(SUM(beneficiarios_odonto), 0) AS BIGINT), '' FROM individual""",
    "q29_members_lives_med": f"""WITH {INDIVIDUAL}
SELECT 'MED' AS segmento, {rnd('''CAST(COALESCE(SUM(beneficiarios_medicos), 0)
  + COALESCE(SUM(beneficiarios_odonto), 0) AS DOUBLE) / 1e3''', 1)} AS total_benef
FROM individual""",
    "q30_members_lives_odo": f"""WITH {PANEL}
SELECT segmento, {rnd("CAST(associadas AS DOUBLE) / 1e3", 1)} AS total_benef
FROM series WHERE competencia = {CURRENT} AND segmento = 'ODO'""",
    "q31_member_growth": f"""WITH {PANEL}
SELECT segmento, {rnd("var_tri_assoc * 100", 1)} AS var_a FROM yoy
WHERE competencia = {CURRENT}""",
    "q32_member_coverage": f"""WITH {PANEL}
SELECT segmento, {ratio("associadas", "mercado")} AS perc_a,
  {num(rnd(f"100 * {ratio('associadas', 'mercado')}", 1))} || '%' AS texto
FROM series WHERE competencia = {CURRENT} AND segmento = 'MED'""",
    "q33_finance_var": f"""WITH {OWN}, r AS ({metric_rows("own")})
SELECT segmento, tipo, ano_ant, ano_atu, {pct("ano_atu", "ano_ant")} AS var FROM r""",
    "q34_finance_var_cells": f"""WITH {OWN}
SELECT segmento, {growth(INCOME)} AS fat_var_1, {growth(EXPENSE)} AS fat_var_2,
  {growth(OUTCOME)} AS fat_var_3 FROM own GROUP BY segmento""",
    "q35_finance_var_ordered": f"""WITH {OWN}, r AS ({metric_rows("own")})
SELECT segmento, ordem, tipo, ano_ant, ano_atu, {pct("ano_atu", "ano_ant")} AS var FROM r""",
    "q36_period_labels": f"""WITH {FACT}
SELECT DISTINCT segmento, competencia AS trimestre,
  {cases("quarter(competencia)", MONTHS.items())} || ' ' || CAST(year(competencia) AS VARCHAR)
    AS rotulo
FROM fact WHERE competencia IN ({CURRENT}, {PRIOR})""",
    "q37_finance_series": f"WITH {YEARS}\n"
    + "\nUNION ALL\n".join(
        f"SELECT segmento, ano, CAST({i} AS INT) AS ordem, '{t}' AS tipo, {n} AS valor "
        f"FROM years WHERE segmento = '{s.segmento}'"
        for s in (STAR_MED, STAR_ODO)
        for i, (n, t) in enumerate(
            zip(
                (INCOME, EXPENSE, OUTCOME), (s.income_label, s.expense_label, s.result_label)
            ),
            1,
        )
    ),
    "q38_finance_growth": f"""WITH {YEARS}
SELECT segmento, {growth(INCOME)} AS fat_total_cres, {growth(EXPENSE)} AS desp_total_cres
FROM years GROUP BY segmento""",
    "q39_member_count": f"""WITH {MEMBERS}
SELECT segmento, COUNT(*) AS n_associadas FROM raw_members GROUP BY 1""",
    "q40_share_labels": f"""WITH {FACT}, {MEMBERS},
{share("MED", "BUILDING").replace("by_op", "med_op").replace("groups", "med_groups").replace("shares", "med_shares").strip()},
{share("ODO", None).strip()},
every AS (SELECT * FROM med_shares UNION ALL SELECT * FROM shares)
SELECT segmento, CASE WHEN associada = 1 THEN 'Associadas' ELSE 'Não associadas' END AS associada,
  beneficiarios, percentual FROM every""",
    "q42_kpi_table": _kpi_table(),
    "q46_share_with_gaps": f"""WITH {FACT}, {MEMBERS},
by_op AS (SELECT segmento, registro,
            CASE WHEN segmento = 'ODO' AND CAST(registro AS BIGINT) % 97 = 0 THEN NULL
                 ELSE SUM(beneficiarios) END AS v
          FROM fact WHERE competencia = {CURRENT} GROUP BY 1, 2),
groups AS (SELECT segmento, {FLAG},
             CASE WHEN COUNT(*) = COUNT(v) THEN {bsum("v")} END AS beneficiarios
           FROM by_op {FLAGGED} GROUP BY 1, 2)
SELECT segmento, associada, beneficiarios,
  CASE WHEN COUNT(*) OVER w = COUNT(beneficiarios) OVER w
       THEN {ratio("beneficiarios", "SUM(beneficiarios) OVER w")} END AS percentual
FROM groups WINDOW w AS (PARTITION BY segmento)""",
}
# The same results by way of the raw layouts.
ORACLE["q43_result_long_layout"] = ORACLE["q12_result_med"]
ORACLE["q44_result_wide_layout"] = ORACLE["q13_result_odo"]
ORACLE["q45_share_of_requests"] = ORACLE["q11_share_total"]

# The calendar decides there: the quarter of the year before is joined, not counted back.
ORACLE["q47_yoy_with_gap"] = f"""WITH {PANEL},
kept AS (SELECT * FROM series WHERE competencia <> DATE '1998-01-01')
SELECT a.segmento, a.competencia AS trimestre, a.mercado, a.associadas,
  {ratio("a.associadas", "b.associadas")} - 1 AS var_tri_assoc, {ratio("a.mercado", "b.mercado")} - 1 AS var_tri_mercado
FROM kept a LEFT JOIN kept b ON b.segmento = a.segmento AND b.competencia = a.competencia - INTERVAL 1 YEAR
WHERE year(a.competencia) > 1996"""
