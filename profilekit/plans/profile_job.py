"""The batch profile job: four CSV tables in, master, models, metrics and profiles out.

Stage tables are written below ``out``; a later stage reads what an earlier one wrote, so the message texts
are read once and a failed run restarts from the last table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import clean, features, master, measures, model_runs, profiles, propensity, segments, views
from ..session import materialize, temporary
from ..sources import tables


@dataclass
class ProfileJob:
    spark: SparkSession
    out: str
    rules: Sequence[segments.NameRule]
    dims: DataFrame
    product_types: Sequence[str] = tuple(fv.PRODUCT_TYPES)
    targets: dict[str, str] = field(default_factory=lambda: {f"tiene_{p}": p for p in fv.MODELLED_PRODUCTS})
    params: propensity.TreeParams = propensity.TreeParams()
    clusters: int = 6
    restarts: int = 15
    sweep: Sequence[int] = tuple(range(2, 8))
    sweep_restarts: int = 10
    silhouette_rows: int = 5000
    shown: Sequence[str] = ("ingreso_mensual_mxn", "score_buro", "txn_pct_digital", "txn_n_viajes", "prod_util_media", "conv_noise_pct")
    turn_id: str = "message_id"

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.out}/{name}"
        tables.write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def features(
        self, customers: DataFrame, products: DataFrame, transactions: DataFrame, turns: DataFrame
    ) -> DataFrame:
        """Cleans the inputs and writes the labelled turns and the master table."""
        labelled = features.label_turns(clean.clean_turns(turns)).drop("input", "output", "noise_type")
        # the features count texts; rows without one are gone, so a constant stands for it
        labelled = self._stage(labelled, "turnos_etiquetados").withColumn("input", F.lit(""))
        joined = master.master(
            clean.clean_customers(customers),
            features.txn_features(clean.clean_transactions(transactions)),
            features.product_features(clean.clean_products(products), self.product_types),
            features.conv_features(labelled, self.turn_id),
        )
        return self._stage(joined, "master")

    def profiles(self, table: DataFrame) -> DataFrame:
        """Segments, propensity and the profile table from a master table; the models are kept for later use."""
        fitted = segments.Segmentation.fit(table, self.rules, k=self.clusters, restarts=self.restarts)
        fitted.save(self.spark, f"{self.out}/modelos/segmentos")
        segmented = self._stage(fitted.transform(table), "master_segmentado")
        self.segment_outputs(fitted, segmented)
        models = propensity.train_propensity(segmented, self.targets, params=self.params)
        model_runs.save_run(models, f"{self.out}/modelos/propension", **asdict(self.params))
        tables.write_table(models.metrics.drop("top_features"), f"{self.out}/metricas")
        scored = segmented.join(propensity.score_propensity(segmented, models), "user_id")
        modelled = [t.removeprefix("tiene_") for t in models.ensembles]
        return self._stage(profiles.profiles(models.encoder.transform(scored), self.dims, modelled), "perfiles")

    def segment_outputs(self, fitted: segments.Segmentation, segmented: DataFrame) -> None:
        """Writes what tells good segments from bad ones: the sweep over numbers of clusters, the fit's measures, a map and means per segment.

        The measures are null where all rows fell into one segment; means cover those of ``shown`` that the table has.
        """
        with temporary(self.spark):
            vectors = materialize(fitted.scaler.vectors(segmented, ("user_id", "segmento_id", "segmento_nombre")), "segment_vectors")
            tables.write_table(segments.kmeans_sweep(vectors, self.sweep, self.sweep_restarts), f"{self.out}/segmentos_barrido")
            tables.write_table(segments.pca2(vectors, ("user_id", "segmento_id", "segmento_nombre")), f"{self.out}/segmentos_mapa")
            plain = vectors.withColumn("features", vector_to_array("features"))
            values = (None, None, None)
            if plain.select("segmento_id").distinct().count() > 1:
                values = (
                    float(measures.silhouette_squared(plain, "features", "segmento_id")),
                    float(measures.silhouette_sample(plain, "user_id", "features", "segmento_id", self.silhouette_rows)),
                    float(measures.davies_bouldin(plain, "features", "segmento_id")),
                )
            row = (len(fitted.centres), float(fitted.cost), *values)
            schema = "k int, costo double, silueta_cuadrada double, silueta double, davies_bouldin double"
            tables.write_table(self.spark.createDataFrame([row], schema), f"{self.out}/segmentos_medidas")
        shown = [c for c in self.shown if c in segmented.columns]
        tables.write_table(views.segment_profile(segmented, shown), f"{self.out}/segmentos_perfil")

    def run(self, customers: DataFrame, products: DataFrame, transactions: DataFrame, turns: DataFrame) -> DataFrame:
        result = self.profiles(self.features(customers, products, transactions, turns))
        tables.write_table(views.profile_run_summary(result), f"{self.out}/resumen")
        return result

    def run_from_csv(self, customers: str, products: str, transactions: str, turns: str) -> DataFrame:
        return self.run(
            tables.read_customers(self.spark, customers),
            tables.read_products(self.spark, products),
            tables.read_transactions(self.spark, transactions),
            tables.with_turn_ids(tables.read_turns(self.spark, turns), self.turn_id),
        )
