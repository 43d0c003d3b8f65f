"""Encoding, training, search, scoring and explanation on Spark ML."""

from adspark.ml.adam import AdamState, train_in_epochs
from adspark.ml.encode import (
    ImpressionEncoder, LevelEncoderModel, assemble_encoder, code_book,
    encoder_from_counts, encoder_width, encoding_plan, feature_names, standardize,
)
from adspark.ml.explain import explain
from adspark.ml.score import Scoring, predict, predict_and_save
from adspark.ml.search import grid_search, read_results, show_results, top_results
from adspark.ml.train import (
    TrainingRun, encode_rows, model_width, perceptron, positive_probability,
    train_classifier, train_in_rounds,
)

__all__ = [
    "ImpressionEncoder", "LevelEncoderModel", "Scoring", "TrainingRun",
    "assemble_encoder", "code_book", "encode_rows", "encoder_from_counts",
    "encoder_width", "encoding_plan", "explain", "feature_names", "grid_search", "model_width",
    "perceptron", "positive_probability", "predict", "predict_and_save",
    "read_results", "show_results", "standardize", "top_results",
    "train_classifier", "train_in_rounds",
]
