"""Contacts, signers and sends: first-match lookups, precedence, a trust fold, send plans.

Contacts are searched in the order of ``ord``; every lookup is an equi-join that
Spark plans by size, with the order kept by a minimum over ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_PREVIOUS = 64


def first_match(contacts: DataFrame, key: str) -> DataFrame:
    """The contact of least ``ord`` for each value of a column; null never matches."""
    place = W.partitionBy(key).orderBy("ord")
    return contacts.where(F.col(key).isNotNull()).withColumn("_p", F.row_number().over(place)).where("_p = 1").drop("_p")


def resolve_signers(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds ``case``, ``contact_ord``, ``previous_fingerprint`` and ``previous_verified`` to messages with a ``signer``.

    Order of the rules: unsigned; a contact's current key (its state decides);
    a previous key of any contact (changed, with that key's own fingerprint);
    unknown. Within a rule the contact order decides, then the history order.
    """
    last = F.try_element_at("previous_keys", F.lit(-1))
    current = first_match(contacts, "sig_pub").select(
        F.col("sig_pub").alias("signer"), F.col("ord").alias("c_ord"), F.col("state").alias("c_state"), last["fingerprint"].alias("c_fp"), last["was_verified"].alias("c_ver")
    )
    history = contacts.select("ord", F.posexplode("previous_keys").alias("at", "k")).where("k.sig_pub is not null")
    old = history.groupBy(F.col("k.sig_pub").alias("signer")).agg(F.min(F.struct("ord", "at", F.col("k.fingerprint").alias("fp"), F.col("k.was_verified").alias("ver"))).alias("old"))
    joined = messages.join(current, "signer", "left").join(old, "signer", "left")
    here = F.col("c_ord").isNotNull()
    case = F.when(F.col("signer").isNull(), "unsigned").when(here, F.col("c_state")).when(F.col("old").isNotNull(), "changed").otherwise("unknown")
    changed = here & (F.col("c_state") == "changed")
    return joined.select(
        *messages.columns,
        case.alias("case"),
        F.coalesce("c_ord", "old.ord").alias("contact_ord"),
        F.when(changed, F.col("c_fp")).when(~here, F.col("old.fp")).alias("previous_fingerprint"),
        F.when(changed, F.coalesce("c_ver", F.lit(False))).when(~here, F.col("old.ver")).alias("previous_verified"),
    )


def added(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """New contacts that may be added: no known signing key, the first of each key; without a signing key all may."""
    fresh = new.join(contacts.select("sig_pub").where("sig_pub is not null").distinct(), "sig_pub", "left_anti")
    return first_match(fresh, "sig_pub").unionByName(fresh.where("sig_pub is null"))


def removed(contacts: DataFrame, gone: DataFrame) -> DataFrame:
    """The contacts without those of the ``ord`` in ``gone``; their key history goes with them."""
    return contacts.join(gone.select("ord").distinct(), "ord", "left_anti")


def renamed(contacts: DataFrame, names: DataFrame) -> DataFrame:
    """Contacts under new names, from (ord, name), of which the last in text order counts; all else of a contact stays."""
    new = names.groupBy("ord").agg(F.max("name").alias("_new"))
    return contacts.join(new, "ord", "left").withColumn("name", F.coalesce("_new", "name")).select(*contacts.columns)


def listed(contacts: DataFrame) -> DataFrame:
    """The contacts in their order, one line for each."""
    return contacts.select("ord", "name", "state", F.size("previous_keys").alias("n_previous")).orderBy("ord")


def _fold(events: Column) -> Column:
    """State after a sorted list of (seq, at, action); refused actions are counted."""
    start = F.struct(
        F.lit("seen").alias("state"), F.lit(0).alias("previous"), F.lit(None).cast("long").alias("verified_at"),
        F.lit(None).cast("long").alias("revoked_at"), F.lit(False).alias("last_verified"), F.lit(0).alias("refused"),
    )

    def step(s: Column, e: Column) -> Column:
        action = e["action"]
        revoked = s["state"] == "revoked"
        full = (action == "replace") & (s["previous"] >= MOST_PREVIOUS)
        refused = (revoked & (action != "revoke")) | full
        good = lambda name: ~refused & (action == name)
        return F.struct(
            F.when(good("verify"), "verified").when(good("unverify"), "seen").when(good("revoke"), "revoked").when(good("replace"), "changed").otherwise(s["state"]).alias("state"),
            (s["previous"] + F.when(good("replace"), 1).otherwise(0)).alias("previous"),
            F.when(good("verify"), e["at"]).when(~good("unverify") & ~good("replace"), s["verified_at"]).alias("verified_at"),
            F.when(good("revoke"), e["at"]).otherwise(s["revoked_at"]).alias("revoked_at"),
            F.when(good("replace"), s["state"] == "verified").otherwise(s["last_verified"]).alias("last_verified"),
            (s["refused"] + F.when(refused, 1).otherwise(0)).alias("refused"),
        )

    return F.aggregate(events, start, step)


def fold_trust(events: DataFrame, key: str = "contact_id") -> DataFrame:
    """Trust state of each contact after its events (seq, at, action: verify, unverify, revoke, replace).

    Revoked is final for all but another revoke; a full key history refuses
    further keys. The fold is ordered, so one contact's events meet in one row.
    """
    got = events.where(F.col("action").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "action"))).alias("e"))
    return got.select(key, _fold(F.col("e")).alias("s")).select(key, "s.*")


def plan_sends(recipients: DataFrame, contacts: DataFrame, message: str = "message_id") -> DataFrame:
    """For each message: refused or not and why, warnings, and the suite (hybrid if all recipients have such a key).

    ``recipients`` has (message, contact); ``contacts`` has (contact, state, hybrid).
    """
    got = recipients.join(contacts, "contact", "left")
    plan = got.groupBy(message).agg(
        F.count("*").alias("n_recipients"),
        F.bool_or(F.col("state").isNull()).alias("missing"),
        F.coalesce(F.bool_or(F.col("state") == "revoked"), F.lit(False)).alias("revoked"),
        F.bool_and(F.coalesce("hybrid", F.lit(False))).alias("all_hybrid"),
        F.count_if(F.col("state").isin("changed", "seen")).alias("n_warnings"),
    )
    fault = F.when(F.col("missing"), "missing recipient").when(F.col("revoked"), "revoked recipient").otherwise("")
    return plan.select(message, "n_recipients", fault.alias("refused"), "n_warnings", F.when(F.col("all_hybrid"), "hybrid").otherwise("classical").alias("suite"))
