"""Spoken forms of integers in Spanish and Papiamentu, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the numbers, in order from 0.
ES_UNITS = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
).split()
#: from 30 on
ES_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = "cien doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
ES_TOO_LARGE = "Número demasiado grande"
PAP_UNITS = "sero un dos tres kuater sinku seis shete ocho nuebe dies diesun diesdos diestres dieskuater diesinku diesseis diesshete diesocho diesnuebe binti".split()
#: from 30 on
PAP_TENS = "trinta kuarenta sinkuenta sesenta shetenta ochenta nobenta".split()
PAP_TOO_LARGE = "Number ta hopi grandi"


def _pick(words: list[str], i: Column) -> Column:
    return F.try_element_at(F.lit(words), (i + 1).cast("int"))


def _scaled(n: Column, below: Column, above: Column, too_large: str) -> Column:
    return F.when((n < 0) | n.isNull(), F.lit(None).cast("string")).when(n < 1000, below).when(n < 1_000_000, above).otherwise(too_large)


def int_to_spanish(n: Column) -> Column:
    """0 to 999999; one thousand is 'uno mil'. Null for negative numbers."""

    def under_hundred(x: Column) -> Column:
        ten, unit = F.floor(x / 10), x % 10
        return F.when(x < 30, _pick(ES_UNITS, x)).when(unit == 0, _pick(ES_TENS, ten - 3)).otherwise(F.concat_ws(" y ", _pick(ES_TENS, ten - 3), _pick(ES_UNITS, unit)))

    def under_thousand(x: Column) -> Column:
        hundred, rest = F.floor(x / 100), x % 100
        head = F.when((hundred == 1) & (rest > 0), "ciento").otherwise(_pick(ES_HUNDREDS, hundred - 1))
        return F.when(x < 100, under_hundred(x)).when(rest == 0, head).otherwise(F.concat_ws(" ", head, under_hundred(rest)))

    thousands, rest = F.floor(n / 1000), n % 1000
    above = F.concat(under_thousand(thousands), F.lit(" mil"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), under_thousand(rest))))
    return _scaled(n, under_thousand(n), above, ES_TOO_LARGE)


def int_to_papiamentu(n: Column) -> Column:
    """0 to 999999; 21 to 29 are all 'binti'. Null for negative numbers."""

    def under_hundred(x: Column) -> Column:
        ten, unit = F.floor(x / 10), x % 10
        return F.when(x <= 20, _pick(PAP_UNITS, x)).when(x < 30, PAP_UNITS[20]).when(unit == 0, _pick(PAP_TENS, ten - 3)).otherwise(F.concat_ws(" i ", _pick(PAP_TENS, ten - 3), _pick(PAP_UNITS, unit)))

    def under_thousand(x: Column) -> Column:
        hundred, rest = F.floor(x / 100), x % 100
        head = F.when(hundred == 1, "shen").otherwise(F.concat(_pick(PAP_UNITS, hundred), F.lit("shen")))
        return F.when(x < 100, under_hundred(x)).when(rest == 0, head).otherwise(F.concat_ws(" ", head, under_hundred(rest)))

    thousands, rest = F.floor(n / 1000), n % 1000
    head = F.when(thousands == 1, "mil").otherwise(F.concat(under_thousand(thousands), F.lit(" mil")))
    above = F.concat(head, F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), under_thousand(rest))))
    return _scaled(n, under_thousand(n), above, PAP_TOO_LARGE)
