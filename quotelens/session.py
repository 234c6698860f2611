"""Session settings the plans count on, applied only where the user set nothing."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import SparkSession

# A join whose result is aggregated on the join key is left skewed by default,
# because splitting it costs one more shuffle; that shuffle moves partial
# aggregates only, so it is worth taking.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Bloom filters of join keys, over scans of what is no longer broadcast. Filters have
    # 32 MB at most, and plans that know their keys make them smaller (:func:`fit_filters`).
    # Key sets of over 1 GB make none.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "10MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "96000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "96000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "268435456",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "268435456",
    # Joins of the mart's wide rows, generated as one method each, took the JVM's compiler
    # up to 1.8 GB of an executor outside its heap. Those on more fields are not fused.
    "spark.sql.codegen.maxFields": "50",
}

_FILTER = "spark.sql.optimizer.runtime.bloomFilter."
_ITEMS, _BITS = _FILTER + "expectedNumItems", _FILTER + "numBits"
#: At six bits a key one in eighteen rows without a partner passes.
BITS_PER_KEY = 6
LEAST_BITS = 1 << 19
#: A filter takes no more than this part of the driver's heap.
DRIVER_PART = 384
_fitting = Lock()

#: Ways to write the zone that timestamps are meant in.
UTC_NAMES = ("UTC", "ETC/UTC", "GMT", "Z", "+00:00", "UTC+0", "GMT+0")


def configure(spark: SparkSession) -> SparkSession:
    """Fill in :data:`DEFAULTS`; a value given at launch or by the user is kept.

    Bloom filters that an earlier mart was fitted with get the size back that they had before.
    """
    with _fitting:
        for name in (_ITEMS, _BITS):
            if (value := _given(spark, name)) is not None:
                spark.conf.set(name, value)
    given = spark.conf.getAll
    for name, value in DEFAULTS.items():
        if name not in given:
            spark.conf.set(name, value)
    return spark


def _given(spark: SparkSession, name: str) -> str | None:
    """The value that a session had before :func:`fit_filters` put its own in its place."""
    now = spark.conf.get(name, None)
    ours = now is not None and now == spark.conf.get(f"quotelens.fitted.{name}", None)
    return spark.conf.get(f"quotelens.given.{name}") if ours else now


def fit_filters(spark: SparkSession, keys: int | None = None, at_least: bool = False) -> None:
    """Give Bloom filters made from now on room for ``keys`` keys, or the most where it is not known.

    Spark makes them all of one size, and the driver holds each several times over: as it
    comes, as it is read, and in the tasks that it is sent with. So they have no more bits
    than the keys at hand need, than a small part of the driver's memory holds, and than
    the session was given or :data:`DEFAULTS` say. ``at_least``: leave them as they are if
    they are fitted to more keys already. A smaller filter lets more rows pass to the join,
    which drops them, so results are the same with any.
    """
    with _fitting:
        given = {name: _given(spark, name) for name in (_ITEMS, _BITS)}
        if None in given.values():
            return
        now, most = int(spark.conf.get(_BITS)), int(given[_BITS])
        ours = spark.conf.get(f"quotelens.fitted.{_BITS}", None) == str(now)
        bits = min(most, 8 * spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // DRIVER_PART)
        if keys is not None:
            bits = min(bits, max(LEAST_BITS, keys * BITS_PER_KEY))
        if at_least and ours and bits <= now:
            return
        # Hashes are of these: four where each key has its bits, fewer where there is no room.
        items = max(keys or 0, bits // BITS_PER_KEY)
        for name, value in ((_ITEMS, items), (_BITS, bits)):
            spark.conf.set(f"quotelens.given.{name}", given[name])
            spark.conf.set(f"quotelens.fitted.{name}", value)
            spark.conf.set(name, value)


def check_session(spark: SparkSession) -> None:
    """Refuse a session whose dates or casts would differ from the documented ones.

    A timestamp turns into a date in the session's zone, and a bad number or an
    overflow raises under ANSI mode only.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone is {zone}; the plans need UTC")
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("spark.sql.ansi.enabled is off; the plans need it on")
