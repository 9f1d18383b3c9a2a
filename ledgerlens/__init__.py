"""ledgerlens — payment-transaction analytics expressed as Spark DataFrame plans.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects
(or a dict of them) and performs no action unless it is a *fit* step
(model training, exact quantile selection, category vocabulary).
"""

from ledgerlens.schema import FilterParams
from ledgerlens.session import build_session, shared_dir


def __getattr__(name):
    # the service pulls in pyspark.ml; import it only when asked for
    if name == "AnalyticsService":
        from ledgerlens.plans.service import AnalyticsService

        return AnalyticsService
    raise AttributeError(name)


__all__ = ["AnalyticsService", "FilterParams", "build_session", "shared_dir"]
__version__ = "0.1.0"
