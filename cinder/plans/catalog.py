"""Import every plan module so its queries register."""

from cinder.plans import (clean_q, coarse_q, diag_q, flagship, geo_q, metrics_q, model_q, sample_q,  # noqa: F401
                          source_q, stream_q,
                          zonal_q)
from cinder.plans.registry import ORACLE, QUERIES  # noqa: F401
