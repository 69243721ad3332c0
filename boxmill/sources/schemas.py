"""Schemas of the files that detection work leaves behind."""

from pyspark.sql import types as T

COUNTS = "struct<TP:bigint,FP:bigint,FN:bigint,precision:double,recall:double>"
METRICS = T.StructType([
    T.StructField("summary", T.StructType([T.StructField(n, T.LongType()) for n in ("TP", "FP", "FN")] + [T.StructField(n, T.DoubleType()) for n in ("precision", "recall")])),
    T.StructField("per_class", T.MapType(T.StringType(), T.StructType([T.StructField(n, T.LongType()) for n in ("TP", "FP", "FN")] + [T.StructField(n, T.DoubleType()) for n in ("precision", "recall")]))),
])
RESULTS = """filename string,
  true_positives struct<boxes:array<array<double>>,classes:array<int>>,
  false_positives struct<boxes:array<array<double>>,classes:array<int>,scores:array<double>>,
  false_negatives struct<boxes:array<array<double>>,classes:array<int>>"""
TEMPLATE = "map<string,map<string,int>>"
#: Columns of a training curve as its file names them, and as they are called here.
CURVE = {
    "epoch": "epoch", "time": "time", "train/box_loss": "train_box_loss", "train/cls_loss": "train_cls_loss", "train/dfl_loss": "train_dfl_loss",
    "metrics/precision(B)": "precision", "metrics/recall(B)": "recall", "metrics/mAP50(B)": "map50", "metrics/mAP50-95(B)": "map50_95",
    "val/box_loss": "val_box_loss", "val/cls_loss": "val_cls_loss", "val/dfl_loss": "val_dfl_loss", "lr/pg0": "lr_pg0", "lr/pg1": "lr_pg1", "lr/pg2": "lr_pg2",
}
#: The species of ablation tables, and the weights of blue, green and red in a grey level.
SPECIES = ("BRAIIM", "LIRIBO", "TRIAVA")
GREY = (0.114, 0.587, 0.299)
