"""Job-posting and exam-calendar analytics as Spark DataFrame operators."""
