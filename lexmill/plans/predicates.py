"""What questions ask for and what blocks say, by terms in normalised texts; the cascade that narrows candidates by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import any_of, normalize_folded
from lexmill.operators.ranking import cascade, preferred_first

# Terms that mark questions and blocks in Italian knowledge bases. Terms of one house (its products and
# tests) are left to the caller.
OVERVIEW = (
    "mi parli della", "mi parli del", "mi parli di ", "parlami della", "parlami del", "parlami di ", "cos e ", "cosa e ",
    "che cos e", "che cosa e", "overview", "panoramica", "descrizione della", "descrizione del", "descrivimi la", "descrivimi il",
)
DIAGNOSTIC = (
    "come verifico", "come faccio a verificare", "come controllo", "come faccio a controllare", "come faccio a capire se",
    "come posso capire se", "come posso verificare", "come si verifica", "come si controlla", "verificare se", "controllare se",
    "come faccio a sapere se", "come posso essere sicuro", "come posso essere certa", "come posso essere certo",
    "come faccio a essere sicuro", "come faccio a essere certo",
)
STRUCTURAL = (
    "spessa", "spessore", "spess", "1 2", "1 5", "2 0", "due lamiere", "doppia lamiera", "lamiera doppia", "sovrappost",
    "propulsore forte", "propulsore molto forte", "classe alta", "potenza alta", "fuori eta", "fuori campo", "non coperto",
    "coperto dalle prestazioni", "prestazioni dichiarate", "non rappresentativo", "deformazione non rappresentativa",
)
STRUCTURAL_BLOCK = (
    "spesso", "spessore", "fuori campo", "fuori eta", "doppia lamiera", "due lamiere", "lamiera sovrapposta", "non rappresentativa",
    "sovra infissione", "propulsore", "rigidezza aumentata", "rigidita aumentata",
)
AMBIENT_BLOCK = ("ghiaccio", "acqua", "condensa", "bagnata", "umidita", "vibrazione", "vibra", "puntale scivola", "sporco", "residui", "clack")
NEGATION = ("non posso", "in quali casi non", "quando non posso", "quando non si puo", "non e valido", "non e ammesso", "non si deve", "non coperto", "non rappresentativo")
NEGATION_BLOCK = ("errore", "fuori campo", "non valido", "non ammesso", "sovra infissione", "deformazione anomala")
GEOMETRY = ("lamiera", "ondina", "onda", "ala", "imbarcata", "laminazione", "rigonfiamento", "bombatura", "rigidita", "rigidezza")
DEFECT = ("chiodo", "chiodi", "punta", "danneggiata", "danneggiato", "difettoso", "difettosi")
KILLER_IDS = ("ERR", "KILLER", "LIMITE", "LIMITI")
KILLER = (
    "errore", "errore di posa", "fuori campo", "non valido", "non ammesso", "da considerarsi non valido", "difetto", "difettoso", "anomalia",
    "anomala", "sovra infissione", "deformazione anomala", "colpo non valido", "testa schiacciata", "propulsore eccessivo",
)


@dataclass(frozen=True)
class Terms:
    """The terms of all predicates; limits and limits_id have no general values."""

    overview: tuple[str, ...] = OVERVIEW
    diagnostic: tuple[str, ...] = DIAGNOSTIC
    structural: tuple[str, ...] = STRUCTURAL
    structural_block: tuple[str, ...] = STRUCTURAL_BLOCK
    ambient_block: tuple[str, ...] = AMBIENT_BLOCK
    negation: tuple[str, ...] = NEGATION
    negation_block: tuple[str, ...] = NEGATION_BLOCK
    geometry: tuple[str, ...] = GEOMETRY
    defect: tuple[str, ...] = DEFECT
    killer_ids: tuple[str, ...] = KILLER_IDS
    killer: tuple[str, ...] = KILLER
    limits: tuple[str, ...] = ()
    limits_id: str = "LIMITI-APPLICAZIONE"


def asks(norm: Column, terms: Terms = Terms()) -> dict[str, Column]:
    """What a normalised question asks for, one flag each."""
    names = ("overview", "diagnostic", "structural", "negation", "geometry", "limits")
    return {f"asks_{k}": any_of(norm, getattr(terms, k)) for k in names}


def says(ident: Column, question: Column, triggers: Column, tags: Column, terms: Terms = Terms()) -> dict[str, Column]:
    """What a block says, one flag each: in its question and triggers, with its id, or with id and tags."""
    text = lambda c: F.coalesce(c, F.lit(""))
    once = lambda c, body: F.element_at(F.transform(F.array(c), body), 1)  # noqa: E731  # a text is normalised once, not for each term
    told = F.array_join(F.coalesce(triggers, F.array().cast("array<string>")), " ")
    own = normalize_folded(F.concat_ws(" ", text(question), told))
    named = normalize_folded(F.concat_ws(" ", text(ident), text(question), told))
    full = normalize_folded(F.concat_ws(" ", F.nullif(ident, F.lit("")), F.nullif(question, F.lit("")), F.nullif(told, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    upper = F.upper(text(ident))
    return {
        "is_structural": once(own, lambda t: any_of(t, terms.structural_block) & ~any_of(t, terms.ambient_block)),
        "is_negated": once(own, lambda t: any_of(t, terms.negation_block)),
        "is_geometric": once(named, lambda t: ~any_of(t, terms.defect) | any_of(t, terms.geometry)),
        "is_safe": ~(any_of(upper, terms.killer_ids) | once(full, lambda t: any_of(t, terms.killer))),
        "is_limits": F.contains(upper, F.lit(terms.limits_id)),
        "is_overview": F.contains(upper, F.lit("OVERVIEW")),
    }


def narrowed(candidates: DataFrame, by: str, *order: Column) -> DataFrame:
    """The candidates that five stages leave (structural, negation, geometry, diagnostic, limits), with their rank.

    candidates carry the flags of asks() and says(). A stage applies where the question asks for it, and narrows only
    where it leaves any; the last puts limit blocks first. One exchange for all."""
    col = F.col
    stages = [(col("asks_structural"), col("is_structural")), (col("asks_negation"), col("is_negated")), (col("asks_geometry"), col("is_geometric")), (col("asks_diagnostic"), col("is_safe"))]
    return preferred_first(cascade(candidates, by, stages), by, col("asks_limits") & col("is_limits"), *order)
