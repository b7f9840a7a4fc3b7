"""Reserved: the inputs are finished tables read by Spark itself."""
