"""Structure discovery in categorical data on Spark DataFrames."""

from .algebra import Model, bottom, independence, model_df, parse_model, saturated
from .operators.analyzer import Analyzer, Compat, FitResult
from .plans.search import SearchResult, chow_liu, search, tree_model
from .schema import Direction, Schema, SearchFilter, Statistic, TableKind, Variable
from .sources.formats import DataSet, load

__all__ = ["Analyzer", "Compat", "DataSet", "Direction", "FitResult", "Model", "Schema", "SearchFilter", "SearchResult", "Statistic", "TableKind", "Variable",
           "bottom", "chow_liu", "independence", "load", "model_df", "parse_model", "saturated", "search", "tree_model"]
