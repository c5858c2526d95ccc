"""Queries over the driver's tables: importing this package registers them all."""

from tessera.plans import image_queries as image_queries
from tessera.plans import series_queries as series_queries
from tessera.plans import rank_queries as rank_queries
from tessera.plans import matrix_queries as matrix_queries
from tessera.plans import model_queries as model_queries
from tessera.plans import inference_queries as inference_queries
from tessera.plans import spatial_queries as spatial_queries
from tessera.plans import more_queries as more_queries
from tessera.plans import extra_queries as extra_queries
from tessera.plans import decomposition_queries as decomposition_queries
from tessera.plans import glm_queries as glm_queries
from tessera.plans import resampling_queries as resampling_queries
from tessera.plans import alignment_queries as alignment_queries
from tessera.plans import volume_queries as volume_queries
from tessera.plans import adjacency_queries as adjacency_queries
from tessera.plans.registry import join_twins

join_twins()
